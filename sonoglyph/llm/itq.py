"""Operator 8, embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact cosines.

Rotations are learned, on a bounded sample, that make the signs of the centred and rotated vectors balanced binary codes. A
code is cut into disjoint substrings, each of which is the key of one table, so that codes which differ in few bits agree in
some table. Where vectors have a direction in common, the same cosine leaves centred ones further apart: the width of the keys and
the number of tables follow from the length of the sample's mean (``tables_for``), at every number of vectors alike. Equal vectors are one class. Classes in one bucket of a table are
compared by cosine in double precision in blocks of bounded size, and each pair counts only in the first table in which it
meets, so links are counted without being listed. A block passes on one edge for each linked class, to the smallest id
that it is connected to within the block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoglyph.llm.graph import components
from sonoglyph.llm.store import cut, discard, table

#: Vectors that the rotations are learned on, at most: the first in the order of a hash of vec_id.
SAMPLE = 20_000
ITERATIONS = 30
SEED = 7
COSINE = 0.95
#: Bits of a code, and of a key: there are CODE_BITS / KEY_BITS tables. Wider keys make smaller buckets; for the same recall
#: they need longer codes. Of vectors at cosine 0.95 one bit in ten differs, so that a key of 16 bits agrees in 18 % of cases.
CODE_BITS = 320
KEY_BITS = 16
#: Part of the pairs at the least cosine that may not meet, where vectors have a direction in common, and most tables for it.
MISSED, MOST_TABLES = 0.015, 256
#: Part of all pairs whose cosines are few enough; more tables of wider keys are not asked for then.
FEW_PAIRS = 0.02
#: Vectors of a bucket that one block holds at most, of each of two parts.
BLOCK = 512


def learn_rotation(vectors: np.ndarray, iterations: int = ITERATIONS, seed: int = SEED) -> np.ndarray:
    """Iterative quantisation of unit vectors: alternately the signs of the rotated vectors, and the rotation that comes nearest to them."""
    d = vectors.shape[1]
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    for _ in range(iterations):
        signs = np.where(vectors @ rotation >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(vectors.T @ signs)
        rotation = u @ vt
    return rotation


def learn_rotations(vectors: np.ndarray, bits: int) -> np.ndarray:
    """As many rotations side by side, each learned from a start of its own, as give codes of so many bits."""
    return np.hstack([learn_rotation(vectors, seed=SEED + i) for i in range(-(-bits // vectors.shape[1]))])[:, :bits]


def tables_for(common: float, cosine: float = COSINE, code_bits: int = CODE_BITS, key_bits: int = KEY_BITS) -> tuple[int, int]:
    """Bits of a key and number of tables for vectors whose mean has the squared length ``common``.

    Centred, vectors at ``cosine`` are at (cosine - common) / (1 - common), which says how many of their bits agree. With little in
    common it is ``key_bits`` and ``code_bits``; else, of the widths that miss no more than MISSED, the one with the fewest tables
    whose cosines are few, or with the fewest cosines. No bits and one table, all pairs in blocks, is what is left where keys would save nothing.
    """
    given = (key_bits, code_bits // key_bits)
    centred = (cosine - common) / (1 - common) if common < 1 else 0.0
    agree = 1 - np.arccos(np.clip(centred, 0, 1)) / np.pi
    if (1 - agree**key_bits) ** given[1] <= max(MISSED, (1 - (1 - np.arccos(cosine) / np.pi) ** key_bits) ** given[1]) * 1.1:
        return given
    fits = [(k, int(np.ceil(np.log(MISSED) / np.log(1 - agree**k)))) for k in range(1, key_bits + 1)]
    fits = [(k, n) for k, n in fits if n <= MOST_TABLES]
    few = [(k, n) for k, n in fits if n <= FEW_PAIRS * 2**k]
    k, n = min(few, key=lambda x: x[1]) if few else min(fits, key=lambda x: x[1] / 2 ** x[0], default=(0, 1))
    return (k, n) if n < 2**k else (0, 1)


def vectors_of(column: pa.Array, wide: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable vector (not null, finite, not zero, of length ``wide`` or of the first one's), and their vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, values = np.asarray(column.offsets), column.values
    size = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
    flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    some = np.concatenate([[0], np.cumsum(flat != 0)])
    good = (size > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & (some[offsets[1:]] > some[offsets[:-1]])
    if wide is None:
        wide = int(size[good][0]) if good.any() else 0
    rows = np.flatnonzero(good & (size == wide))
    return rows, flat[offsets[rows][:, None] + np.arange(wide)]


def widths_of(column: pa.Array) -> list[int]:
    return np.unique(pc.fill_null(pc.list_value_length(column), 0)).tolist()


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(np.float64).tiny)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray, rotations: np.ndarray, key_bits: int, mean: np.ndarray | float = 0.0) -> np.ndarray:
    """The keys of each unit vector, one a table."""
    if not key_bits:
        return np.zeros((len(x), 1), np.int64)
    bits = ((x - mean) @ rotations >= 0).reshape(len(x), -1, key_bits)
    return (bits << np.arange(key_bits, dtype=np.int64)).sum(axis=2)


def _codes(sent, key_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys and bytes of usable vectors; those of another length than the sample's have keys of their own, by rotations at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, rotations = sent.value
        for batch in batches:
            for wide in widths_of(batch.column("embedding")):
                rows, vectors = vectors_of(batch.column("embedding"), wide)
                if not wide or not len(rows):
                    continue
                if wide == len(rotations):
                    keys = codes(units(vectors), rotations, key_bits, mean)
                else:
                    turned = np.random.default_rng(wide).normal(size=(wide, rotations.shape[1]))
                    keys = codes(units(vectors), turned, key_bits) ^ (wide << 48)
                ids = batch.column("vec_id").take(pa.array(rows))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids, flat, pa.array([v.tobytes() for v in vectors], pa.binary())], ["vec_id", "keys", "vector"])

    return run


def _links(ids: np.ndarray, part: np.ndarray, x: np.ndarray, keys: np.ndarray, mixed: bool, tab: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block, each way, that link and have not met in an earlier table."""
    near = x @ x.T >= cosine
    near &= ids[:, None] != ids[None, :]
    if mixed:  # pairs within one part are another block's
        near &= part[:, None] != part[None, :]
    a, b = np.nonzero(near)
    fresh = ~(keys[a, :tab] == keys[b, :tab]).any(axis=1)
    return a[fresh], b[fresh]


def _small_links(group: np.ndarray, ids: np.ndarray, x: np.ndarray, keys: np.ndarray, tab: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for many blocks of one part each: rows of each in a run, compared with the row k further on for every k."""
    found_a, found_b, tables = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(keys.shape[1])
    for k in range(1, int(np.bincount(group).max())):
        a = np.flatnonzero(group[:-k] == group[k:])
        a = a[np.einsum("ij,ij->i", x[a], x[a + k]) >= cosine]
        a = a[ids[a] != ids[a + k]]
        a = a[~((keys[a] == keys[a + k]) & (tables < tab[a, None])).any(axis=1)]
        found_a += [a, a + k]
        found_b += [a + k, a]
    return np.concatenate(found_a), np.concatenate(found_b)


def _blocks(kind: np.dtype, cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come in the order of their blocks; the last block of a batch waits for the next batch."""

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        wide = pc.binary_length(t.column("vector"))
        for w in pc.unique(wide):  # a block's vectors are of one length
            yield of_length(t.filter(pc.equal(wide, w)))

    def of_length(t: pa.Table) -> pa.RecordBatch:
        ids, tab, part, low, high, copies = (t.column(k).to_numpy() for k in ("vec_id", "tab", "part", "low", "high", "copies"))
        x = units(np.frombuffer(b"".join(t.column("vector").to_pylist()), kind).reshape(len(ids), -1))
        keys = np.asarray(t.column("keys").combine_chunks().flatten()).reshape(len(ids), -1)
        group = np.cumsum(_begins(t)) - 1
        size = np.bincount(group)
        few = (size[group] <= 16) & (low == high)
        small = np.flatnonzero(few)
        a, b = _small_links(np.unique(group[small], return_inverse=True)[1], ids[small], x[small], keys[small], tab[small], cosine) if len(small) else (small, small)
        pairs_a, pairs_b = [small[a]], [small[b]]
        start = np.cumsum(size) - size
        for g in np.unique(group[~few]):
            rows = slice(start[g], start[g] + size[g])
            a, b = _links(ids[rows], part[rows], x[rows], keys[rows], low[start[g]] != high[start[g]], tab[start[g]], cosine)
            pairs_a.append(a + start[g])
            pairs_b.append(b + start[g])
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        # the smallest row that each is connected to; rows of a block are in the order of vec_id
        root = np.arange(len(ids))
        while len(a):
            least = root.copy()
            np.minimum.at(least, a, root[b])
            least = least[least]
            if (least == root).all():
                break
            root = least
        links = np.bincount(a, copies[b], minlength=len(ids)).astype(np.int64)
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(ids[root[at]])], ["vec_id", "n", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            begins = np.flatnonzero(_begins(held))
            if len(begins) > 1:
                yield from compare(held.slice(0, begins[-1]).combine_chunks())
                held = held.slice(begins[-1])
        if held is not None and held.num_rows:
            yield from compare(held.combine_chunks())

    return run


def _begins(t: pa.Table) -> np.ndarray:
    """Whether each row begins a block."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for k in ("tab", "key", "low", "high"):
        v = t.column(k).to_numpy()
        out[1:] |= v[1:] != v[:-1]
    return out


def near_vectors(vectors: DataFrame, *, cosine: float = COSINE, sample: int = SAMPLE, code_bits: int = CODE_BITS, key_bits: int = KEY_BITS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Two vectors link if the index lets them meet and their cosine is at least ``cosine``; equal ones always do. n_links is
    the number of other vec_ids linked, component_id the smallest vec_id reachable by links, kept whether that is the
    vector's own. Null and zero vectors and those with null or non-finite components link with nothing, nor does a null vec_id;
    vectors link with those of their own length alone, which the most frequent one of the sample's has learned rotations for. Of rows that repeat a vec_id the least usable vector counts,
    and all share its links. No rows, no rows; other columns are not read. ``code_bits`` is a multiple of ``key_bits``.
    """
    if code_bits % key_bits or not 0 < key_bits <= 48:
        raise ValueError("code_bits is a multiple of key_bits, key_bits at most 48")
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fits = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    chosen = vectors.where(F.col("embedding").isNotNull() & fits).orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample).toArrow()
    if not chosen.num_rows:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    column = chosen.column("embedding").combine_chunks()
    wide = np.bincount(pc.list_value_length(column).to_numpy()).argmax()
    _, known = vectors_of(column, int(wide))
    mean = units(known).mean(axis=0)
    key_bits, tables = tables_for(float(mean @ mean), cosine, code_bits, key_bits)
    rotations = spark.sparkContext.broadcast((mean, learn_rotations(units(known) - mean, max(1, key_bits * tables))))
    coded = vectors.where("vec_id is not null").mapInArrow(_codes(rotations, key_bits), "vec_id long, keys array<long>, vector binary")
    coded = coded.groupBy("vec_id").agg(F.min(F.struct("vector", "keys")).alias("v")).select("vec_id", "v.*")
    coded = cut(coded.withColumn("print", F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(7), "vector").alias("b"))), "itq-codes")

    # equal vectors are one class, which its smallest vec_id stands for
    classes = coded.groupBy("print").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    member = cut(coded.select("vec_id", "print").join(classes, "print").select("vec_id", "rep", "copies"), "itq-classes")
    firsts = coded.join(member.where("vec_id = rep").select("vec_id", "copies"), "vec_id").select("vec_id", "copies", "keys", "vector")
    entries = firsts.select("vec_id", F.posexplode("keys").alias("tab", "key"))
    # only vectors that meet another one go on; large buckets are opened in pairs of parts
    sizes = entries.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    met = entries.join(sizes, ["tab", "key"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, "part").alias("low"), F.greatest(p, "part").alias("high")))
    blocks = met.select("vec_id", "tab", "key", "part", F.explode(others).alias("b")).select("vec_id", "tab", "key", "part", "b.low", "b.high")
    order = ["tab", "key", "low", "high"]
    sorted_ = blocks.join(firsts, "vec_id").repartition(*order).sortWithinPartitions(*order, "vec_id")
    found = cut(sorted_.mapInArrow(_blocks(known.dtype, cosine), "vec_id long, n long, to long"), "itq-links")
    counts = found.groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n").alias("n"))
    reached = components(found.select(F.col("vec_id").alias("u"), F.col("to").alias("v")))
    linked = member.join(counts, "rep", "left").join(reached.withColumnRenamed("id", "rep"), "rep", "left")
    linked = linked.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = cut(linked, "itq-linked")
    discard(coded, member, found)
    out = vectors.select("vec_id").join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op8_iterative_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_iterative_quantisation": op8_iterative_quantisation}
ORACLE_SQL = {
    "op8_iterative_quantisation": r"""
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
walk(id, seen) as (select u, v from link union select w.id, l.v from walk w join link l on l.u = w.seen),
comp as (select id, least(id, min(seen)) as c from walk group by id),
cnt as (select u, count(*) as n from link group by u)
select e.vec_id, coalesce(cnt.n, 0) as n_links, coalesce(comp.c, e.vec_id) as component_id, coalesce(comp.c, e.vec_id) = e.vec_id as kept
from embeddings e left join cnt on cnt.u = e.vec_id left join comp on comp.id = e.vec_id
""",
}
