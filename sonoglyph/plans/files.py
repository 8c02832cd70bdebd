"""Queries that write files of lines and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoglyph.plans.registry import Registry, read
from sonoglyph.sources.lines import numbered, read_presets, read_utterances, write_utterances
from sonoglyph.sources.shared import scratch

R = Registry()


@R.query("""
select text, case when turn % 3 = 0 then lower(text) end as processed_text, case when turn % 2 = 0 then [conv_id, turn] end as phoneme_ids, (conv_id % 7)::int as speaker_id from conversations""")
def utterance_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances as lines of JSON and back."""
    turns = read(spark, sf_dir, "conversations").select("text", F.when(F.col("turn") % 3 == 0, F.lower("text")).alias("processed_text"), F.when(F.col("turn") % 2 == 0, F.array("conv_id", "turn")).alias("phoneme_ids"), (F.col("conv_id") % 7).cast("int").alias("speaker_id"))
    path = scratch(spark, "utterances")
    write_utterances(turns, path)
    return read_utterances(spark, path).where("error is null").select("text", "processed_text", "phoneme_ids", "speaker_id")


@R.query("""
with l as (select c_custkey, case when c_custkey % 10 = 0 then '' when c_custkey % 10 = 1 then '{"text": ' else c_name end as line from customer)
select line as text from l where trim(line) <> ''""")
def utterance_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of plain text as utterances; blank ones are left out."""
    lines = read(spark, sf_dir, "customer").select(F.expr("case when c_custkey % 10 = 0 then '' when c_custkey % 10 = 1 then '{\"text\": ' else c_name end").alias("value"))
    path = scratch(spark, "lines")
    lines.write.text(path)
    return read_utterances(spark, path, json=False)


@R.query("""
with l as (select s_suppkey, 'voice ' || (s_suppkey % 40) || case when s_suppkey % 2 = 0 then ' (warm): ' else ': ' end || s_name || ':' || s_suppkey as line from supplier where s_suppkey % 6 <> 0)
select trim(string_split(string_split(line, ':')[1], '(')[1]) as key, max_by(trim(substr(line, strpos(line, ':') + 1)), s_suppkey) as text from l group by 1""")
def preset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of presets by key; of equal keys the last line counts, lines without a colon none."""
    line = F.expr("case when s_suppkey % 6 = 0 then s_name else 'voice ' || (s_suppkey % 40) || case when s_suppkey % 2 = 0 then ' (warm): ' else ': ' end || s_name || ':' || s_suppkey end")
    path = scratch(spark, "presets")
    read(spark, sf_dir, "supplier").orderBy("s_suppkey").coalesce(1).select(line.alias("value")).write.text(path)  # one file: its lines have an order
    return read_presets(spark, path)


@R.query("""
with n as (select c_custkey, row_number() over (order by c_custkey) as number from customer)
select number, 'utt ' || c_custkey as text from n where c_custkey % 5 <> 0""")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their number in the file, blank ones counted and left out."""
    path = scratch(spark, "numbered")
    rows = read(spark, sf_dir, "customer").orderBy("c_custkey").coalesce(1)
    rows.select(F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("utt "), "c_custkey")).alias("value")).write.text(path)
    return numbered(spark, path).where("trim(value) <> ''").select("number", F.col("value").alias("text"))


QUERIES, ORACLE_SQL = R.queries, R.sql
