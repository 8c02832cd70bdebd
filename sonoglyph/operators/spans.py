"""Spans of texts and symbol sequences: words with their places, tokens found one after the other, splices, vectors of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sonoglyph.dims import BEGIN, END, PAD


def word_offsets(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, word, start, end) of the runs of word characters of each text; a null text has none."""
    runs = df.select(*key, F.posexplode(F.regexp_extract_all(text, F.lit(r"(?U)\w+|\W+"), F.lit(0))).alias("_pos", "word"))
    upto = F.sum(F.length("word")).over(Window.partitionBy(*key).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("end", upto).where(F.col("word").rlike(r"(?U)^\w")).select(*key, "word", (F.col("end") - F.length("word")).alias("start"), "end")


def overlapping(spans: DataFrame, tokens: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of ``spans`` (key, start, end, ...) and ``tokens`` (key, token, token_start, token_end, ...) that overlap."""
    return spans.join(tokens, key).where("token_start < end and token_end > start")


def token_offsets(text: Column, tokens: Column) -> Column:
    """(token, start, end) of the tokens, each looked for from the end of the one found before it; those not found are left out."""
    kind = "array<struct<token:string,start:int,end:int>>"

    def step(a: Column, t: Column) -> Column:
        at = F.call_function("locate", t, text, a["pos"] + 1)
        here = F.struct(t.alias("token"), (at - 1).alias("start"), (at - 1 + F.length(t)).alias("end"))
        return F.when(at > 0, F.struct((at - 1 + F.length(t)).alias("pos"), F.concat(a["out"], F.array(here)).alias("out"))).otherwise(a)

    return F.aggregate(tokens, F.struct(F.lit(0).alias("pos"), F.expr("array()").cast(kind).alias("out")), step)["out"]


def splice(symbols: Column, words: Column) -> Column:
    """Symbols with words replaced. ``words`` are ordered (start, end, marks, instead): a word's symbols but for its last
    ``marks`` ones give way to ``instead``, unless that is null; what is between words stays."""
    part = lambda a, b: F.slice(symbols, a + 1, F.greatest(b - a, F.lit(0)))
    put = F.transform(words, lambda w, i: F.concat(
        part(F.when(i == 0, 0).otherwise(F.get(words, i - 1)["end"]), w["start"]),
        F.when(w["instead"].isNull(), part(w["start"], w["end"])).otherwise(F.concat(w["instead"], part(w["end"] - w["marks"], w["end"])))))
    last = F.when(F.size(words) > 0, F.element_at(words, -1)["end"]).otherwise(0)
    return F.concat(F.flatten(put), part(last, F.size(symbols)))


def mapped_ids(symbols: Column, ids: dict[str, list[int]], *, begin: list[int] | None = None, end: list[int] | None = None, pad: list[int] | None = None) -> Column:
    """Ids of symbols of one or more ids each: begin, pad, each known symbol's ids and a pad after them, end."""
    begin, end, pad = (x if x is not None else [y] for x, y in ((begin, BEGIN), (end, END), (pad, PAD)))
    array = lambda values: F.array(*(F.lit(x) for x in values)) if values else F.expr("array()").cast("array<int>")
    table = F.create_map(*(x for s, v in ids.items() for x in (F.lit(s), array(v))))
    known = F.filter(F.transform(symbols, lambda s: F.element_at(table, s)), lambda v: v.isNotNull())
    return F.concat(array(begin), array(pad), F.flatten(F.transform(known, lambda v: F.concat(v, array(pad)))), array(end))


def word_vectors(words: DataFrame, tokens: DataFrame, key: list[str]) -> DataFrame:
    """(key, vector): the mean of the vectors of ``tokens`` (key, token, token_start, token_end, vector) that overlap a
    word's span in ``words`` (key, start, end), without any that of token 0."""
    met = words.join(tokens, key).where("token_start < end and token_end > start or token = 0")
    hit = (F.col("token_start") < F.col("end")) & (F.col("token_end") > F.col("start"))
    parts = met.select(*key, hit.alias("_hit"), F.posexplode("vector").alias("i", "x"))
    means = parts.groupBy(*key, "i").agg(F.coalesce(F.avg(F.when(F.col("_hit"), F.col("x"))), F.avg("x")).alias("x"))
    return means.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select(*key, F.transform("s", lambda v: v["x"]).alias("vector"))
