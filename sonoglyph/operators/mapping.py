"""Words of a text and the phoneme groups that speak them, over all sentences, with the punctuation that falls into a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sonoglyph.operators.segment import space_groups


def map_words(sentences: DataFrame, words: DataFrame, punctuation: DataFrame, key: list[str]) -> DataFrame:
    """(key, sentence, word, text_start, text_length, start, end, n_punct): the n-th word goes with the n-th group of symbols between
    spaces, counted through all sentences, as far as both go; start and end count within the sentence.

    ``sentences`` (key, sentence, symbols), ``words`` (key, word, text_start, text_length) and ``punctuation`` (key, mark, position,
    n_symbols), whose positions count through all sentences. A group has the symbols of the first mark that begins in it, else 0.
    All joins and windows are by ``key``: one shuffle of each input. Empty and null sentences have no group.
    """
    by_key = Window.partitionBy(*key)
    before = F.coalesce(F.sum(F.size("symbols")).over(by_key.orderBy("sentence").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sentences.where("symbols is not null").select(*key, "sentence", before.alias("_shift"))
    groups = space_groups(sentences, [*key, "sentence"], "symbols").join(shifts, [*key, "sentence"])
    groups = groups.withColumn("_n", F.row_number().over(by_key.orderBy("sentence", "group")))
    words = words.withColumn("_n", F.row_number().over(by_key.orderBy("word")))
    pairs = groups.join(words, [*key, "_n"]).select(*key, "sentence", "word", "text_start", "text_length", "start", "end", "_shift")
    marks = punctuation.select(*key, "mark", "position", "n_symbols")
    inside = (F.col("position") >= F.col("start") + F.col("_shift")) & (F.col("position") < F.col("end") + F.col("_shift"))
    met = pairs.join(marks, key).where(inside).groupBy(*key, "word").agg(F.min_by("n_symbols", "mark").alias("n_punct"))
    return pairs.join(met, [*key, "word"], "left").select(*key, "sentence", "word", "text_start", "text_length", "start", "end", F.coalesce("n_punct", F.lit(0)).cast("int").alias("n_punct"))
