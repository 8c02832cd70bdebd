"""Utterances from lines of JSON, or of plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

UTTERANCE = "text string, processed_text string, phonemes array<string>, phoneme_ids array<bigint>, speaker_id int"


def read_utterances(spark: SparkSession, path: str, *, json: bool = True) -> DataFrame:
    """One row for each line that is not blank; a line of text is an utterance's text. Lines that are no JSON have an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if not json:
        return lines.select(F.col("value").alias("text"))
    parsed = lines.select("value", F.from_json("value", UTTERANCE).alias("u"))
    broken = F.col("u").isNull() | (F.col("u.text").isNull() & F.col("u.phoneme_ids").isNull())
    return parsed.select("u.*", F.when(broken, F.concat(F.lit("no utterance: "), F.left("value", F.lit(80)))).alias("error"))


def write_utterances(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, value) of the lines of text files, numbered from 1 in each file. A file is one row here: for files of
    settings and lists, which are small."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n", -1)).alias("number", "value"))
    return lines.select("path", (F.col("number") + 1).cast("long").alias("number"), "value")


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """(key, text) of lines ``key(...): text``; parted at the first colon, the key at its first parenthesis; of equal keys the last."""
    rows = numbered(spark, path).where(F.contains("value", F.lit(":")))
    parts = F.split("value", ":", 2)
    keyed = rows.select(F.trim(F.substring_index(parts[0], "(", 1)).alias("key"), F.trim(parts[1]).alias("text"), F.struct("path", "number").alias("at"))
    return keyed.groupBy("key").agg(F.max_by("text", "at").alias("text"))
