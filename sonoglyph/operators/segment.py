"""Runs, islands and groups of ordered rows: scripts, languages, speakers, phoneme groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from sonoglyph.dims import SCRIPTS

#: A run of one named script, of common or of inherited characters, or one character of anything else; the most frequent first.
RUNS = "(?s)" + "|".join(rf"\p{{Is{s}}}+" for s in ["Latin", "Common", "Inherited", *(s for s in SCRIPTS if s != "Latin")]) + "|.+?"


def script_of(run: Column) -> Column:
    """Script of a run of one script; ASCII is told by its number, which spares most runs the patterns."""
    first = F.ascii(run)
    ladder = F.when(first.between(97, 122) | first.between(65, 90), "Latin").when(first < 128, "Common").when(run.rlike(r"^\p{IsLatin}"), "Latin")
    for s in ["Common", "Inherited", *SCRIPTS[1:]]:
        ladder = ladder.when(run.rlike(rf"^\p{{Is{s}}}"), s)
    return ladder.otherwise("Unknown")


def script_runs(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, seq, run, start, end, script) of the maximal runs of one script of each text, in code points; the runs make up the text."""
    runs = df.select(*key, F.posexplode(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))).alias("seq", "run"))
    before = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("run")).over(before), F.lit(0))
    return runs.select("*", start.alias("start"), (start + F.length("run")).alias("end"), script_of(F.col("run")).alias("script"))


def fill_language(df: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """Adds ``filled``: the language, where it is undetermined that of the last determined span, at the beginning that of the first one."""
    known = F.nullif("language", F.lit("und"))
    up_to = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.min_by(known, F.when(known.isNotNull(), F.col(order))).over(Window.partitionBy(*key))
    return df.withColumn("filled", F.coalesce(F.last(known, True).over(up_to), first, F.lit("und")))


def islands(df: DataFrame, key: list[str], value: str, order: str = "seq") -> DataFrame:
    """Adds ``island``, which counts the changes of a value along the order; nulls equal each other."""
    w = Window.partitionBy(*key).orderBy(order)
    change = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn("_change", change.cast("int")).withColumn("island", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def merge_languages(df: DataFrame, key: list[str]) -> DataFrame:
    """Adjacent spans (key, seq, run, start, end, script, language) of one language as one; undetermined ones join the language before them.

    A merged span's script is the first one that is not Common of its own language's spans, else Common.
    """
    marked = islands(fill_language(df, key), key, "filled")
    seen = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_led", F.last(F.nullif("language", F.lit("und")), True).over(seen).isNotNull() | (F.col("filled") == "und"))
    named = F.when(F.col("_led") & (F.col("script") != "Common"), F.col("seq"))
    out = marked.groupBy(*key, "island", F.col("filled").alias("language")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "run"))), lambda x: x["run"]), "").alias("text"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.coalesce(F.min_by("script", named), F.lit("Common")).alias("script"))
    return out.withColumnRenamed("island", "seq")


def _class(scripts: list[str], without: bool = False) -> str:
    """A character class of scripts, or of all but them; ASCII is told by its number, which spares most characters the scripts."""
    named, latin = "".join(rf"\p{{Is{s}}}" for s in scripts), "Latin" in scripts
    if not without:
        return f"[{'A-Za-z' * latin}{named}]"
    return rf"[{r'\x00-\x40\x5b-\x60\x7b-\x7f' if latin else r'\x00-\x7f'}[^{named}]]"


def merged_scripts(df: DataFrame, key: list[str], languages: dict[str, str], text: str = "text", shown: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """``merge_languages`` of ``script_runs`` where a run's script alone names its language and all others are undetermined:
    (key, seq, language, text, start, end, script), with ``shown`` of each span's text.

    A span begins with a character that names its language and ends before one that names another; what precedes the first
    one is the first span's. So spans are found as stretches of the text: no run becomes a row, and texts are not shuffled.
    """
    named = list(languages)
    tails = (_class([s]) + (_class(others, True) if (others := [o for o in named if languages[o] != languages[s]]) else "(?s:.)") + "*+" for s in named)
    head = rf"\A{_class(named, True)}++"
    spans = F.regexp_extract_all(text, F.lit(rf"{head}\z|(?:{head})?+(?:{'|'.join(tails)})"), F.lit(0))
    found = df.select(*key, F.monotonically_increasing_id().alias("_row"), spans.alias("_spans"))
    rows = found.select(*key, "_row", F.posexplode("_spans").alias("seq", "_span"))
    first = F.regexp_extract("_span", _class(named), 0)
    script = F.when(first != "", script_of(first)).otherwise(script_of(F.regexp_extract("_span", r"\P{IsCommon}|\z", 0)))
    rows = rows.select(*key, "_row", (F.col("seq") + 1).cast("long").alias("seq"), shown(F.col("_span")).alias("text"), F.length("_span").alias("_n"), script.alias("script"))
    end = F.sum("_n").over(Window.partitionBy("_row").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    language = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in languages.items() for x in kv)), F.col("script")), F.lit("und"))
    return rows.withColumn("end", end).select(*key, "seq", language.alias("language"), "text", (F.col("end") - F.col("_n")).alias("start"), "end", "script")


def merge_speakers(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Adjacent texts of one speaker (null is one) joined by a space; a break (null text) parts them and stays."""
    part = F.when(F.col("text").isNull(), F.concat(F.lit("break"), F.col(order).cast("string"))).otherwise(F.concat(F.lit("said"), F.coalesce("speaker", F.lit("\0"))))
    marked = islands(df.withColumn("_part", part), key, "_part", order)
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(F.col(order).alias("o"), "text")))), lambda x: x["text"])
    return marked.groupBy(*key, F.col("island").alias("seq")).agg(F.max("speaker").alias("speaker"), F.nullif(F.array_join(texts, " "), F.lit("")).alias("text"), F.count(F.lit(1)).alias("n_parts"))


def space_groups(df: DataFrame, key: list[str], symbols: str) -> DataFrame:
    """(key, group, start, end) of the runs of symbols between spaces; empty ones are left out."""
    rows = df.select(*key, F.posexplode(symbols).alias("pos", "symbol"))
    spaces = F.sum(F.when(F.col("symbol") == " ", 1).otherwise(0)).over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    grouped = rows.withColumn("g", spaces).where("symbol <> ' '").groupBy(*key, "g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    return grouped.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy("g")).alias("group"), "start", "end")
