"""Operator 9, quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are UTF-16 code units, all of them, and a text's edge, so that a 4-gram is one 64-bit number whatever
the script. Trusted text gives a table of 4-gram counts, sharded by n-gram; joins of counts with their contexts' totals,
and of each order with the next lower one, give interpolated probabilities. Nothing of the model is collected or sent to
all tasks: documents lie in chunks of bounded size, each chunk asks for its distinct 4-grams, the asked 4-grams are
joined with the model's shards order by order, and what each chunk asked for comes back to it and is summed up by
document. A document's perplexity is compared with a quantile of the held-out trusted documents of its language: half of
the trusted text trains the model, the other half sets the thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sonoglyph.llm import text as T
from sonoglyph.llm.store import cut, discard, table

ORDER = 4
#: Bits of a symbol. The edge is U+FFFF, which is no character.
BITS = 16
SYMBOLS = 1 << BITS
EDGE = SYMBOLS - 1
#: Characters of a chunk, about; a longer text is a chunk of its own.
CHUNK = 1 << 24
#: Quantile of the perplexity of held-out trusted documents, by language.
QUANTILE = 0.995
#: Held-out documents of a language below which all languages' quantile is used.
LEAST_HELD_OUT = 50
#: So much of each count goes to the lower order at least, and no n-gram has probability 0.
LEAST_DISCOUNT = 0.01
#: Perplexities are compared in steps of this many in their logarithm.
STEP = 1e-4


def _keys(s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each symbol of each text and at its end edge, and the bounds of each text's."""
    parts = [s.data[a:b].tobytes().decode("utf-8", "replace").encode("utf-16-le") for a, b in zip(s.offsets, s.offsets[1:], strict=False)]
    sizes = np.array([len(p) // 2 for p in parts], np.int64)
    units, bounds = np.frombuffer(b"".join(parts), "<u2"), np.concatenate([[0], np.cumsum(sizes)])
    pad = ORDER - 1
    line = np.full(len(units) + s.n_docs * pad + pad, EDGE, np.uint64)
    line[np.arange(len(units)) + (np.repeat(np.arange(s.n_docs), sizes) + 1) * pad] = units
    key = line[pad:].copy()
    for i in range(1, ORDER):
        key |= line[pad - i : len(line) - i] << np.uint64(BITS * i)
    # of the edges after a text only the first is predicted
    ends = bounds[1:] + np.arange(s.n_docs) * pad
    keep = np.ones(len(key), bool)
    for i in range(1, pad):
        keep[ends + i] = False
    return key[keep], bounds + np.arange(s.n_docs + 1)


def _texts(batch: pa.RecordBatch) -> pa.Array:
    """Texts that travelled compressed."""
    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([None if x is None else expand(x) for x in batch.column("packed").to_pylist()], pa.binary()).cast(pa.large_binary()).view(pa.large_string())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string()).view(pa.large_binary())
        packed = pa.array([None if x is None else compress(x) for x in texts.to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), packed], [*(c for c in batch.schema.names if c != "text"), "packed"])


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with the column packed, the text compressed on its own, in place of text: less to shuffle."""
    rest = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest, "text").mapInArrow(_pack, f"{kinds}, packed binary")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in T.slices(_texts(batch)):
            key, n = np.unique(_keys(s)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "c"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct 4-grams of each chunk; rows come chunk by chunk."""

    def out(chunk: int, found: list[np.ndarray]) -> pa.RecordBatch:
        key = np.unique(np.concatenate(found))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), chunk)), pa.array(key.view(np.int64))], ["chunk", "key"])

    now, found = None, []
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        for s in T.slices(_texts(batch)):
            key, bounds = _keys(s)
            own = chunks[s.first : s.first + s.n_docs]
            for at in np.split(np.arange(s.n_docs), np.flatnonzero(np.diff(own)) + 1):
                if own[at[0]] != now and found:
                    yield out(now, found)
                    found = []
                now = own[at[0]]
                found.append(np.unique(key[bounds[at[0]] : bounds[at[-1] + 1]]))
                if len(found) > 32:
                    found = [np.unique(np.concatenate(found))]
    if found:
        yield out(now, found)


def _score(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Log-probability and number of symbols of each document of a chunk."""
    key = answers.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    key, log_p = key[order], answers.column("log_p").to_numpy()[order]
    out = []
    for batch in texts.to_batches():
        total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for s in T.slices(_texts(batch)):
            asked, bounds = _keys(s)
            rows = slice(s.first, s.first + s.n_docs)
            total[rows] = np.add.reduceat(log_p[np.searchsorted(key, asked)], bounds[:-1])
            count[rows] = np.diff(bounds) - 1
        out.append(pa.RecordBatch.from_arrays([*(batch.column(c) for c in _SCORED[:3]), pa.array(count), pa.array(total)], _SCORED))
    return pa.Table.from_batches(out, pa.schema(list(zip(_SCORED, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()], strict=True))))


_SCORED = ["doc_id", "lang", "text_hash", "n_symbols", "log_prob"]


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from the numbers of n-grams counted 1 to 4 times."""
    row = counts.agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5))).first()
    n = [0, row["n1"], row["n2"], row["n3"], row["n4"]]
    if not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(i - (i + 1) * y * n[i + 1] / n[i], LEAST_DISCOUNT), float(i)) if n[i] else float(i) / 2 for i in (1, 2, 3)]


def _suffix(n: int) -> Column:
    """The last n symbols of an n-gram."""
    return F.col("key").bitwiseAND((1 << BITS * n) - 1)


def model(trusted_text: DataFrame) -> dict[int, tuple[DataFrame, list[float]]]:
    """Tables of counts by order, each with its discounts: 4-grams of ``trusted_text`` (packed), and below the highest
    order in how many contexts an n-gram was seen."""
    counts = {ORDER: cut(trusted_text.mapInArrow(_count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "kneser-ney")}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = cut(counts[n + 1].groupBy(_suffix(n).alias("key")).agg(F.count(F.lit(1)).alias("c")), "kneser-ney")
    return {n: (c, _discounts(c)) for n, c in counts.items()}


def probabilities(asked: DataFrame, counts: dict[int, tuple[DataFrame, list[float]]], n: int = ORDER) -> DataFrame:
    """(key, p) of each distinct n-gram of ``asked`` (key): its discounted share of its context, plus what the context
    leaves times the probability of the next lower order; a context without counts leaves all."""
    if n == 0:
        return asked.select("key", F.lit(1.0 / SYMBOLS).alias("p"))
    seen, d = counts[n]
    context = F.shiftrightunsigned("key", BITS)
    # an array, not constants in the expressions, so that all tables run the same compiled code
    off = F.element_at(F.array(*(F.lit(x) for x in d)), F.least(F.col("c"), F.lit(3)).cast("int"))
    left = F.sum(off) / F.sum("c")
    contexts = seen.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), left.alias("left"))
    lower = probabilities(asked.select(_suffix(n - 1).alias("key")).distinct(), counts, n - 1).select(F.col("key").alias("suffix"), F.col("p").alias("below"))
    share = F.coalesce(F.greatest(F.col("c") - off, F.lit(0.0)) / F.col("total"), F.lit(0.0))
    rows = asked.select("key", context.alias("context"), _suffix(n - 1).alias("suffix"))
    joined = rows.join(seen, "key", "left").join(contexts, "context", "left").join(lower, "suffix")
    return joined.select("key", (share + F.coalesce("left", F.lit(1.0)) * F.col("below")).alias("p"))


def kneser_ney(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE, least_held_out: int = LEAST_HELD_OUT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, lang, text_hash, n_symbols, perplexity, threshold, kept) of every row of ``docs`` (doc_id, text, lang);
    text_hash is ``xxhash64(text)``.

    Perplexity is per UTF-16 code unit, over the whole text and its end; bytes that are no UTF-8 count as U+FFFD. A null or
    empty text has null perplexity and is not kept. A null language, and one with fewer than ``least_held_out`` held-out
    trusted documents, takes the threshold of all languages together; without any, everything with text is kept. Repeated
    rows each give a row; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("text_hash"), "text")
    trusted = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    trusted = trusted.withColumn("fits", F.pmod(F.xxhash64(F.lit("fits"), "doc_id"), F.lit(2)) == 0)

    # by a shuffle at every size: labels have no bound that would allow a broadcast
    fits = docs.where("text <> ''").where(F.pmod(F.xxhash64(F.lit("fits"), "doc_id"), F.lit(2)) == 0).select("doc_id", "text")
    counts = model(_packed(fits).join(trusted.where("fits").select("doc_id").hint("merge"), "doc_id", "left_semi").select("packed"))

    n_chunks = max(1, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // chunk))
    placed = _packed(docs.where("text <> ''").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n_chunks))))
    # all of the rest is one job: its exchange of texts serves what chunks ask for and what they do with the answers,
    # that of what was asked serves the model's joins and the way back
    placed = placed.repartition(min(n_chunks, MOST_TASKS), "chunk")
    asked = placed.sortWithinPartitions("chunk").mapInArrow(_asked, "chunk long, key long").repartition(min(n_chunks, MOST_TASKS), "key")
    answers = probabilities(asked.select("key").distinct(), counts).select("key", F.ln("p").alias("log_p"))
    back = asked.join(answers, "key").select("chunk", "key", "log_p")
    scored = placed.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_score, "doc_id long, lang string, text_hash long, n_symbols long, log_prob double")
    empty = docs.where("text is null or text = ''").select("doc_id", "lang", "text_hash", F.lit(0).cast("long").alias("n_symbols"), F.lit(0.0).alias("log_prob"))
    scored = cut(scored.union(empty), "perplexity")
    discard(*(c for c, _ in counts.values()))
    return _verdicts(scored, trusted, quantile, least_held_out)


#: Tasks that chunks are dealt to at most; more chunks share tasks.
MOST_TASKS = 20_000


def _verdicts(scored: DataFrame, trusted: DataFrame, quantile: float, least_held_out: int) -> DataFrame:
    mean = -F.col("log_prob") / (F.col("n_symbols") + 1)
    scored = scored.withColumn("step", F.when(F.col("n_symbols") > 0, F.ceil(mean / STEP)))
    held = scored.where("step is not null").join(trusted.where("not fits").select("doc_id"), "doc_id", "left_semi").select("lang", "step")
    held = cut(held.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n")), "held-out")
    at = F.expr(f"cast(percentile(step, {quantile!r}, n) as double)")
    rest = held.agg(at.alias("most")).first()["most"]
    # the step that is reached at the quantile: percentile interpolates, so what lies between two steps is the upper one
    known = held.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n"), F.ceil(at).alias("most")).where(f"n >= {int(least_held_out)}").select("_lang", "most")
    joined = scored.join(known, F.col("lang") == F.col("_lang"), "left")
    most = F.coalesce("most", F.lit(None if rest is None else int(np.ceil(rest))).cast("long"))
    return joined.select(
        "doc_id", "lang", "text_hash", "n_symbols", F.when(F.col("n_symbols") > 0, F.exp(mean)).alias("perplexity"),
        F.exp(most * STEP).alias("threshold"), F.coalesce(F.col("step") <= F.coalesce(most, F.col("step")), F.lit(False)).alias("kept"))


def keep_likely(docs: DataFrame, labels: DataFrame, **tuning) -> DataFrame:
    """The rows of ``docs`` that ``kneser_ney`` keeps; rows of equal doc_id, lang and text have one verdict."""
    gone = kneser_ney(docs, labels, **tuning).where("not kept").select(*(F.col(c).alias(f"_{c}") for c in _SCORED[:3])).distinct()
    same = (docs["doc_id"].eqNullSafe(gone["_doc_id"])) & (docs["lang"].eqNullSafe(gone["_lang"])) & (F.xxhash64(docs["text"]) == gone["_text_hash"])
    return docs.join(gone, same, "left_anti")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_kneser_ney": op9_kneser_ney}
ORACLE_SQL: dict[str, str] = {}
