"""Operator 1, quality rules: base text rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed buckets of token unigrams and bigrams are counted: one over a trusted target, one over
the raw corpus. A document's score is its log-likelihood ratio divided by its number of n-grams; every document is
kept or not by one threshold, the score that a stated share of the trusted documents does not reach.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sonoglyph.llm import text as T
from sonoglyph.llm.store import cut, discard, table

#: log2 of the number of buckets.
BITS = 14
#: Share of the trusted documents that the threshold may turn away.
REJECTED_TRUSTED = 0.005
#: n-grams of score 0 that each document gets besides its own, so that a short one is not judged on two words.
PRIOR_GRAMS = 10
#: Added to each bucket's count.
SMOOTHING = 1.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 word, 2 punctuation
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1


def _buckets(s: T.Slice, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each unigram and bigram; tokens are runs of word bytes or of punctuation, case kept."""
    kind = _KIND[s.data]
    edge = np.zeros(len(kind) + 1, bool)
    edge[s.offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(edge)
    if len(at) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = at[:-1], at[1:]
    start, end = start[kind[start] != 0], end[kind[start] != 0]
    doc = np.searchsorted(s.offsets, start, "right") - 1
    tokens = T.Words(doc, start, end, T.spans_hash(s.data, start, end), np.zeros(0))
    pairs, grams = T.ngrams(tokens, 2)
    shift = np.uint64(64 - bits)
    return np.concatenate([doc, doc[pairs]]), (np.concatenate([tokens.hash, grams]) >> shift).astype(np.int64)


def _count(bits: int, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for s in T.slices(batch.column("text")):
                n += np.bincount(_buckets(s, bits)[1], minlength=1 << bits)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", name])

    return run


def base_stats(s: T.Slice) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a slice."""
    n, w = s.n_docs, T.words(s, lower=False)
    cum = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    letters = cum(((s.data & 0xC0) != 0x80) & ~T.is_space(s.data))
    symbols = cum(_SYMBOL[s.data])
    out = {"n_words": np.diff(w.bounds), "word_chars": np.diff(letters[s.offsets]), "n_symbols": np.diff(symbols[s.offsets])}
    # lines: each ends at \n or at its text's end
    breaks = np.flatnonzero(s.data == 10)
    begin = np.unique(np.concatenate([s.offsets[:-1], breaks + 1]))
    begin = begin[begin < len(s.data)]
    doc = np.searchsorted(s.offsets, begin, "right") - 1
    end = np.minimum(np.append(breaks, len(s.data))[np.searchsorted(breaks, begin)], s.offsets[doc + 1])
    worded = cum(~T.is_space(s.data))
    has = worded[end] > worded[begin]
    begin, end, doc = begin[has], end[has], doc[has]
    out["n_dup_lines"] = np.bincount(doc[_again(doc, s.data, begin, end)], minlength=n)
    at, grams = T.ngrams(w, 3)
    repeated = at[_shared(w.doc[at], grams)]
    hit = np.zeros(len(w.doc), bool)
    for i in range(3):
        hit[repeated + i] = True
    out["n_repeat_words"] = np.bincount(w.doc[hit], minlength=n)
    return out


def _runs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by text and key, and whether each in that order equals the one before."""
    order = np.lexsort((key, doc))
    same = np.zeros(len(order), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return order, same


def _again(doc: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans that an earlier one of the same text equals, byte by byte."""
    order, same = _runs(doc, T.spans_hash(data, begin, end))
    later, before = order[1:][same[1:]], order[:-1][same[1:]]
    return later[T.spans_equal(data, begin[later], end[later], begin[before], end[before])]


def _shared(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    order, same = _runs(doc, key)
    first = np.zeros(len(order), bool)
    first[:-1] = same[1:]
    return order[same | first]


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _score(weights, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.frombuffer(weights.value, np.float64)
        for batch in batches:
            n = batch.num_rows
            stats = {k: np.zeros(n, np.int64) for k in _STATS}
            total, grams = np.zeros(n), np.zeros(n, np.int64)
            for s in T.slices(batch.column("text")):
                rows = slice(s.first, s.first + s.n_docs)
                for k, v in base_stats(s).items():
                    stats[k][rows] = v
                doc, bucket = _buckets(s, bits)
                grams[rows] = np.bincount(doc, minlength=s.n_docs)
                total[rows] = np.bincount(doc, ratio[bucket], minlength=s.n_docs)
            out = [batch.column("doc_id"), *(pa.array(stats[k]) for k in _STATS), pa.array(grams), pa.array(total)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", *_STATS, "n_grams", "log_ratio"])

    return run


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all trusted documents (quality 1, toxic 0)."""
    return labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()


def _quantile(scores: DataFrame, part: float) -> float | None:
    """The exact quantile of ``score``, linear between neighbours. Distinct scores are counted and sorted by range, so that no
    task holds all of them; the driver gets a row for each range and the two neighbours."""
    counts = scores.groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    counts = cut(counts.repartitionByRange("score").select("score", "c", F.spark_partition_id().alias("range")), "quality-scores")
    sums = counts.groupBy("range").agg(F.sum("c").alias("c")).orderBy("range").collect()
    total = sum(x["c"] for x in sums)
    found, before, at = {}, 0, part * (total - 1)
    for x in sums:
        for k in {math.floor(at), math.ceil(at)}:
            if before <= k < before + x["c"]:
                upto = F.sum("c").over(Window.partitionBy("range").orderBy("score"))
                found[k] = counts.where(F.col("range") == x["range"]).withColumn("upto", upto).where(F.col("upto") > k - before).agg(F.min("score")).first()[0]
        before += x["c"]
    discard(counts)
    return found[math.floor(at)] + (at - math.floor(at)) * (found[math.ceil(at)] - found[math.floor(at)]) if total else None


def quality_rules(docs: DataFrame, labels: DataFrame, *, bits: int = BITS, rejected_trusted: float = REJECTED_TRUSTED,
                  prior_grams: int = PRIOR_GRAMS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): base statistics, base_failed, score, threshold and kept.

    Both multinomials are counted over whole texts, the raw one over every document, the target over every trusted one; only ``2**bits`` sums reach the
    driver, whatever the corpus. A null text counts as empty and fails the base rules; without a trusted document, or
    with no n-gram at all, scores and the threshold are 0, so that the base rules alone decide. Repeated rows each
    give a row; other columns are not read.
    """
    spark = docs.sparkSession
    ids = trusted_ids(labels).withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", "text")
    # texts go where their labels are once, to be counted; scores, which are small, go there later
    trusted = texts.join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left_semi").select("text")
    sums = [t.select("text").mapInArrow(_count(bits, name), f"bucket long, {name} long").groupBy("bucket").agg(F.sum(name).alias(name)) for name, t in (("raw", texts), ("target", trusted))]
    rows = sums[0].join(sums[1], "bucket", "left").fillna(0).toPandas()
    raw, target = np.full(1 << bits, smoothing), np.full(1 << bits, smoothing)
    raw[rows["bucket"]] += rows["raw"]
    target[rows["bucket"]] += rows["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    if not len(rows) or not rows["target"].sum():
        ratio[:] = 0
    weights = spark.sparkContext.broadcast(ratio.tobytes())
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in _STATS) + ", n_grams long, log_ratio double"
    scored = cut(texts.mapInArrow(_score(weights, bits), schema), "quality-rules")
    scored = scored.withColumn("score", F.col("log_ratio") / (F.col("n_grams") + prior_grams))
    low = _quantile(scored.join(ids, F.col("doc_id") == F.col("_id"), "left_semi").select("score"), rejected_trusted)
    return scored.withColumn("threshold", F.lit(0.0 if low is None else low)).select(
        "doc_id", *_STATS,
        F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed"),
        F.expr("not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and score >= threshold").alias("kept"),
        "score", "threshold",
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL: dict[str, str] = {}
