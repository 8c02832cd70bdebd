"""From raw documents to packed training sequences; each stage reads what the one before it wrote.

Stages but the last return the rows that they keep with the columns of their input, whatever these are called. Rows of null
doc_id are copies of nothing; of rows that repeat a doc_id one text takes part in comparisons, and what is decided holds for
rows of that text alone. Empty tables go through as empty ones.

A stage deletes the temporary tables of the stages before it, which its input, once written, no longer needs.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoglyph.llm.compact_windows import find_passages, remove_passages
from sonoglyph.llm.jaccard_join import keep_first
from sonoglyph.llm.kneser_ney import keep_likely
from sonoglyph.llm.line_dedup import clear_lines
from sonoglyph.llm.packing import pack as pack_sequences
from sonoglyph.llm.store import cut, free_name, recorded, release, table

_left: list[str] = []


def _stage(f):
    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(docs, _left)
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney model of the trusted ones keeps."""
    return keep_likely(docs, table(spark, sf_dir, "labels"))


def _emptied(docs: DataFrame, change) -> DataFrame:
    """``docs`` after a change of text, with n_chars of the new text; rows whose text the change has emptied go."""
    empty = free_name(docs, "_was_empty")
    after = change(docs.withColumn(empty, F.coalesce(F.col("text") == "", F.lit(False)))).where(f"text is null or text <> '' or `{empty}`")
    kinds = {f.name: f.dataType for f in docs.schema}
    return after.select(*(F.length("text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines deleted; a document that consists of them goes."""
    return _emptied(docs, clear_lines)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies: five words, similarity 0.8 or more."""
    return keep_first(docs, size=5, percent=80)


@_stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages cut out; a document that consists of them goes."""
    found = find_passages(docs)
    return _emptied(docs, lambda rows: remove_passages(rows, found))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: their ids, and the pieces of documents in them."""
    return pack_sequences(docs)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", lines), ("jaccard_join", near_copies), ("compact_windows", passages), ("best_fit_packing", pack)]
#: Language models, min-hashes and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: dict[str, str] = {}


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
