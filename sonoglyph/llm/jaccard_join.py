"""Operator 5, n-gram Jaccard join: an exact similarity self-join of documents over a token-group matrix.

Every document is the set of its distinct n-word shingles. Equal sets fall together first. The rest is filtered by the
prefix principle under one global order of shingles, rare ones first: two sets of similarity p share a shingle among
the first ``n - ceil(p n) + 1`` of each. The order comes from a sketch of bounded size that counts all shingles of all
documents; any order gives the same links, a good one fewer candidates. With SHARED - 1 shingles more in each prefix
similar sets share SHARED of them, which chance hardly gives.

Documents that share a prefix shingle are compared with the smallest doc_id among them, their pivot. Similar documents
become groups, one per best pivot; the matrix holds (shingle, group) for the union of each group's prefixes. A query
document whose prefix shares fewer than SHARED shingles with a group's union, or whose size is out of a group's range,
cannot reach the required overlap with any of its members, so only the other groups are opened, in blocks of bounded
size, and never for a document that is already connected to all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sonoglyph.llm import text as T
from sonoglyph.llm.graph import components
from sonoglyph.llm.store import cut, discard, table

#: log2 of the number of counters of the sketch, and the number of rows in which each task sends its own.
SKETCH_BITS = 20
SKETCH_ROWS = 64
#: Prefix shingles that similar sets must share; sets of fewer shingles share all they must.
SHARED = 3
#: Members of a group that one block opens at most, and documents that about one part of a pivot or block compares with it.
BLOCK = 256
PART = 256


def _sketch(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        shift, seen = np.uint64(64 - SKETCH_BITS), False
        for batch in batches:
            for s in T.slices(batch.column("text")):
                _, grams = T.ngrams(T.words(s), size)
                counts += np.bincount((grams >> shift).astype(np.int64), minlength=1 << SKETCH_BITS)
                seen = True
        if seen:
            yield _chunks(counts)

    return run


def _chunks(counts: np.ndarray) -> pa.RecordBatch:
    each = counts.astype(np.int64).reshape(SKETCH_ROWS, -1)
    return pa.RecordBatch.from_arrays([pa.array(range(SKETCH_ROWS), pa.int32()), pa.array([x.tobytes() for x in each], pa.binary())], ["part", "counts"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            more = np.frombuffer(counts.as_buffer(), np.int64)
            sums[part] = sums[part] + more if part in sums else more
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])


def _order_sketch(docs: DataFrame, size: int) -> bytes:
    """2**SKETCH_BITS counters of all shingles, 8 MB whatever the corpus; summed by part, as a stream, before it is fetched."""
    sent = docs.select("text").mapInArrow(_sketch(size), "part int, counts binary")
    rows = sent.repartition(SKETCH_ROWS, "part").mapInArrow(_add, "part int, counts binary").collect()
    counts = np.zeros((SKETCH_ROWS, (1 << SKETCH_BITS) // SKETCH_ROWS), np.int64)
    for r in rows:
        counts[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return counts.astype(np.float32).tobytes()


def _describe(sketch, size: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, shift = np.frombuffer(sketch.value, np.float32), np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            n = batch.num_rows
            count, prints = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
            prefixes: list[np.ndarray | None] = [None] * n
            for s in T.slices(batch.column("text")):
                for row, own in T.shingle_sets(s, size):
                    m = count[row] = len(own)
                    if m:
                        prints[row] = _print(own)
                        least = (percent * m + 99) // 100
                        first = m - least + min(SHARED, least)
                        prefixes[row] = own[np.lexsort((own, order[(own >> shift).astype(np.int64)]))[:first]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(count), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "print_a", "print_b", "prefix"])

    return run


def _print(own: np.ndarray) -> np.ndarray:
    """Two sums that stand for a set."""
    return np.array([own.sum(dtype=np.uint64), T.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).view(np.int64)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and set of the texts of a batch that have the set they are wanted for: of rows that repeat a doc_id, one text counts."""
    wanted = batch.column("print_a").to_numpy()
    for s in T.slices(batch.column("text")):
        for row, own in T.shingle_sets(s, size):
            if _print(own)[0] == wanted[row]:
                yield row, own


def _overlaps(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shared shingles of each document with its pivot; a pivot comes before the documents of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows, shared, total = [], [], []
            pivots, asks = batch.column("grp").to_pylist(), batch.column("asks").to_pylist()
            for row, other in _sets(batch, size):
                if not asks[row]:
                    pivot, own = pivots[row], other
                elif pivots[row] == pivot:
                    rows.append(row)
                    shared.append(len(np.intersect1d(own, other, assume_unique=True)))
                    total.append(len(own) + len(other) - shared[-1])
            out = batch.select(["grp", "doc_id"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["pivot", "doc_id", "shared", "total"])

    return run


def _open(size: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of a block's members, which come first, with its queries that are in other components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets, ids, parts, flat, starts, sizes = None, [], [], [], None, None, None
        for batch in batches:
            out_u, out_v = [], []
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("grp", "block", "part")), strict=True))
            asks, docs, components_ = (batch.column(k).to_pylist() for k in ("asks", "doc_id", "component"))
            for row, own in _sets(batch, size):
                if keys[row] != block:
                    block, sets, ids, parts, flat = keys[row], [], [], [], None
                if not asks[row]:
                    sets.append(own), ids.append(docs[row]), parts.append(components_[row])
                elif sets:
                    if flat is None:
                        sizes = np.array([len(x) for x in sets])
                        flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    shared = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
                    for i in np.flatnonzero(100 * shared >= percent * (sizes + len(own) - shared)):
                        if parts[i] != components_[row]:
                            out_u.append(ids[i]), out_v.append(docs[row])
            yield pa.RecordBatch.from_arrays([pa.array(out_u, pa.int64()), pa.array(out_v, pa.int64())], ["u", "v"])

    return run


def _least_shared(n: str, percent: int) -> Column:
    """Prefix shingles that a set of n shares with any set that is similar to it."""
    smaller = F.floor((percent * F.col(n) + 99) / 100)
    return F.least(F.lit(SHARED), F.floor((percent * smaller + 99) / 100))


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of sizes a and b can be similar at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def jaccard_join(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash) of every row of ``docs`` (doc_id, text); text_hash is ``xxhash64(text)``.

    Words are runs of other than ASCII white space, A to Z in lower case; a text of fewer than ``size`` words has its
    whole sequence as its one shingle. Documents link when ``100 * shared >= percent * union``; component_id is the
    smallest doc_id reachable by links. Null, empty and blank texts have no shingle and link with nothing. Shingles are
    64-bit hashes. Of rows that repeat a doc_id the one of the least set links, the others as far as their sets
    are equal to others; a row of null doc_id comes back as its own null component. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sketch = spark.sparkContext.broadcast(_order_sketch(docs, size))
    schema = "doc_id long, text_hash long, n_shingles long, print_a long, print_b long, prefix array<long>"
    described = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_describe(sketch, size, percent), schema), "jaccard-sets")
    sketch.destroy()  # what it was for is written
    prints = ["n_shingles", "print_a", "print_b"]
    classes = cut(described.where("n_shingles > 0 and doc_id is not null").groupBy(*prints).agg(F.min("doc_id").alias("first")), "jaccard-classes")

    # Posting lists of more than one class: each document with its list's pivot.
    one = described.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*prints, "prefix")).alias("s")).select("doc_id", "s.*")
    chosen = one.join(classes, [*prints]).where("doc_id = first")
    postings = chosen.select("doc_id", "print_a", F.col("n_shingles").alias("n"), F.explode("prefix").alias("shingle"))
    many = postings.groupBy("shingle").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("shingle")
    postings = cut(postings.join(many, "shingle"), "jaccard-postings")
    enough = postings.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= _least_shared("n", percent)).select("doc_id")
    kept = postings.join(enough, "doc_id", "left_semi")
    lists = kept.groupBy("shingle").agg(F.min(F.struct("doc_id", "n", "print_a")).alias("p"), F.max("doc_id").alias("last")).where("p.doc_id < last")
    lists = lists.select("shingle", F.col("p.doc_id").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.print_a").alias("pivot_print"))
    listed = cut(kept.join(lists, "shingle"), "jaccard-lists")
    discard(postings)

    # Everyone against its pivots: a text goes once to each of its pivots, a pivot's text once to each part of its documents.
    pairs = listed.where((F.col("doc_id") != F.col("pivot")) & _fits(F.col("n"), F.col("pivot_n"), percent))
    pairs = pairs.groupBy(F.col("pivot").alias("grp"), "doc_id").agg(F.min("print_a").alias("print_a"), F.min("pivot_print").alias("pivot_print"))
    sizes = pairs.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"), F.min("pivot_print").alias("pivot_print"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    heads = sizes.select("grp", every("parts").alias("part"), F.lit(False).alias("asks"), F.col("grp").alias("doc_id"), F.col("pivot_print").alias("print_a"))
    asking = pairs.drop("pivot_print").join(sizes.select("grp", "parts"), "grp").select("grp", own("parts").alias("part"), F.lit(True).alias("asks"), "doc_id", "print_a")
    both = docs.join(heads.union(asking), "doc_id").repartition("grp", "part").sortWithinPartitions("grp", "part", "asks")
    compared = cut(both.mapInArrow(_overlaps(size), "pivot long, doc_id long, shared long, total long"), "jaccard-pivots")
    links = compared.where(f"100 * shared >= {percent} * total").select(F.col("pivot").alias("u"), F.col("doc_id").alias("v"))
    reached = components(links)

    # Groups by best pivot; the matrix of shingles and groups; groups that a document must open.
    best = compared.where("2 * shared >= total").groupBy("doc_id").agg(F.min_by("pivot", F.struct(-F.col("shared") / F.col("total"), F.col("pivot"))).alias("grp"))
    nodes = listed.select("doc_id", "n", "print_a").distinct().join(best, "doc_id", "left").join(reached.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    nodes = cut(nodes.select("doc_id", "n", "print_a", F.coalesce("grp", "doc_id").alias("grp"), F.coalesce("component", "doc_id").alias("component")), "jaccard-nodes")
    tagged = listed.select("shingle", "doc_id").join(nodes, "doc_id")
    open_lists = tagged.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("shingle")
    tagged = cut(tagged.join(open_lists, "shingle"), "jaccard-matrix")
    matrix = tagged.groupBy("shingle", "grp").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("n_min"), F.max("n").alias("n_max"))
    asks = tagged.select("shingle", "doc_id", "n", "print_a", "component", F.col("grp").alias("own")).join(matrix, "shingle")
    asks = asks.where("low <> component or high <> component").where(f"100 * n >= {percent} * n_min and 100 * n_max >= {percent} * n")
    # within its own group a document that its pivot already links need not ask: the others do
    asks = asks.where("own <> grp or component <> own").groupBy("grp", "doc_id", "print_a").agg(F.first("component").alias("component"), F.count(F.lit(1)).alias("c"), F.min(F.least("n", "n_min")).alias("least"))
    asks = cut(asks.where(F.col("c") >= _least_shared("least", percent)).select("grp", "doc_id", "print_a", "component"), "jaccard-asks")
    opened = asks.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    members = tagged.select("grp", "doc_id", "print_a", "component").distinct().join(opened, "grp")
    blocks = members.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.max("parts").alias("parts"))
    members = members.drop("parts").join(blocks, "grp").select("grp", own("blocks").alias("block"), every("parts").alias("part"), F.lit(False).alias("asks"), "doc_id", "print_a", "component")
    asking = asks.join(blocks, "grp").select("grp", every("blocks").alias("block"), own("parts").alias("part"), F.lit(True).alias("asks"), "doc_id", "print_a", "component")
    place = ["grp", "block", "part"]
    both = docs.join(members.union(asking), "doc_id").repartition(*place).sortWithinPartitions(*place, "asks")
    more = both.mapInArrow(_open(size, percent), "u long, v long")
    parts = nodes.select(F.col("doc_id").alias("u"), F.col("component").alias("cu"))
    more = cut(more.distinct(), "jaccard-opened")
    discard(listed, tagged, asks)
    joined = more.join(parts, "u").join(parts.select(F.col("u").alias("v"), F.col("cu").alias("cv")), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    merged = components(joined)

    final = nodes.select("doc_id", "component").join(merged.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left")
    final = final.select(F.col("doc_id").alias("first"), F.coalesce("top", "component").alias("top"))
    classed = classes.join(final, "first", "left").select(*prints, F.coalesce("top", "first").alias("top"))
    return described.drop("prefix").join(classed, prints, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("top", "doc_id")).alias("component_id"), "text_hash")


def keep_first(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but for those linked, over any path, with a smaller doc_id; rows of equal doc_id and text share a verdict."""
    found = jaccard_join(docs, size=size, percent=percent).where("doc_id <> component_id")
    gone = found.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_doc_id"]) & (F.xxhash64(docs["text"]) == gone["_text_hash"]), "left_anti")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), size=3, percent=90).drop("text_hash")


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLE_SQL = {
    "op5_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select doc_id, case when len(w) = 0 then []
                      when len(w) < 3 then [array_to_string(w, ' ')]
                      else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s
  from w),
cls as (select s, len(s) as n, min(doc_id) as first from (select doc_id, list_sort(s) as s from s) group by s),
tok as (select first, n, unnest(s) as t from cls),
df as (select t, count(*) as c from tok group by t),
ranked as (select first, n, t, row_number() over (partition by first order by c, t) as k from tok join df using (t)),
pre as (select first, n, t from ranked where k <= n - (90 * n + 99) // 100 + 1),
cand as (select distinct a.first as u, b.first as v from pre a join pre b on a.t = b.t and a.first < b.first and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
hits as (select u, v, len(list_intersect(a.s, b.s)) as x, a.n + b.n as total from cand join cls a on a.first = u join cls b on b.first = v),
link as (select u, v from hits where 100 * x >= 90 * (total - x)),
walk(id, seen) as (select u, v from link union select v, u from link
                   union select w.id, l.v from walk w join (select u, v from link union all select v, u from link) l on l.u = w.seen),
comp as (select id, least(id, min(seen)) as c from walk group by id)
select s.doc_id, len(s.s) as n_shingles, case when len(s.s) = 0 then s.doc_id else coalesce(comp.c, cls.first) end as component_id
from (select doc_id, list_sort(s) as s from s) s left join cls on cls.s = s.s left join comp on comp.id = cls.first
""",
}
