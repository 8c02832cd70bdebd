"""Operator 6, best-fit packing: a grouping genetic algorithm on islands.

Documents become token sequences with an end id; only those above the capacity are cut, into whole capacities and a
rest. Pieces are dealt into shards of bounded size, each of which several islands pack. An individual is a grouping of
the shard's pieces into bins. Crossover injects one parent's well-filled bins whole, removes from the other parent every
bin that holds one of their pieces, and best-fits the displaced pieces in decreasing length. After each epoch every
island sends its elite to the next one. Bins of the winners that are not well filled are opened again, and their pieces
dealt anew into fewer shards, until one is left.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoglyph.llm import text as T
from sonoglyph.llm.store import cut, table
from sonoglyph.llm.tokens import vocabulary, word_encoder

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces of one shard, islands of a shard, individuals of an island, epochs and offspring in each; an island that has as few
#: bins as the sum of the lengths allows needs no more of them.
SHARD, ISLANDS, POPULATION, EPOCHS, OFFSPRING = 4096, 2, 8, 2, 40
#: A bin with at most this share of its capacity free stays closed.
WELL_FILLED = 1 / 512
#: Rounds of opening badly filled bins again.
ROUNDS = 6


def _cut_up(path: str, end_id: int, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(path), np.array([end_id], "<u4")
        for batch in batches:
            for s in T.slices(batch.column("text")):
                rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                flat, bounds = encoder.encode(s)
                for i, doc_id in enumerate(batch.column("doc_id").slice(s.first, s.n_docs).to_pylist()):
                    ids = np.concatenate([flat[bounds[i] : bounds[i + 1]].astype("<u4"), end])
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        for k, v in zip(rows, (doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part), strict=True):
                            rows[k].append(v)
                arrays = [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32"))]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in rows["ids"]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, list(rows)[: len(arrays)])

    return run


def pieces(docs: DataFrame, *, vocabulary_path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of ``docs``: its ids and the end id, cut at ``capacity``.

    A null text is empty: its one piece is the end id alone.
    """
    path = vocabulary_path or vocabulary(VOCABULARY)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_cut_up(path, end_id, capacity, with_ids), schema)


# -- one island's work: bins are (free, [piece, ...]); a piece is its index in the shard ------------------------------


def best_fit(order, length: list[int], bins: list[list], capacity: int) -> list[list]:
    """Puts each piece of ``order`` into the bin with the least room that holds it, else into a new one."""
    room: dict[int, list[int]] = {}
    mask = 0
    for b, (free, _) in enumerate(bins):
        if free:
            room.setdefault(free, []).append(b)
            mask |= 1 << free
    for p in order:
        need = length[p]
        above = mask >> need
        if above:
            free = need + (above & -above).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
            bins[b][1].append(p)
            bins[b][0] = left = free - need
        else:
            b, left = len(bins), capacity - need
            bins.append([left, [p]])
        if left:
            room.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


def fitness(bins: list[list], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then the more uneven filling, which leaves better room for what comes later."""
    return -len(bins), sum(((capacity - free) / capacity) ** 2 for free, _ in bins) / max(1, len(bins))


def crossover(one: list[list], other: list[list], length: list[int], capacity: int, rng: random.Random) -> list[list]:
    """Injects well-filled bins of ``one`` whole into ``other``, takes out its bins that share a piece, and best-fits the rest."""
    full = sorted(one, key=lambda b: b[0])[: max(1, len(one) // 2)]
    injected = [[b[0], list(b[1])] for b in full if rng.random() < 0.7] or [[full[0][0], list(full[0][1])]]
    taken = {p for _, ps in injected for p in ps}
    child, displaced = injected, []
    for free, ps in other:
        if taken.isdisjoint(ps):
            child.append([free, list(ps)])
        else:
            displaced += [p for p in ps if p not in taken]
    return mutate(child, displaced, length, capacity, rng)


def mutate(bins: list[list], displaced: list[int], length: list[int], capacity: int, rng: random.Random) -> list[list]:
    """Opens the emptiest bin and a few others, and best-fits all loose pieces in decreasing length."""
    bins = sorted(bins, key=lambda b: b[0])
    for _ in range(min(len(bins), 1 + rng.randrange(3))):
        displaced += bins.pop()[1]
    return best_fit(sorted(displaced, key=lambda p: -length[p]), length, bins, capacity)


def evolve(length: list[int], elite: list[list[list[int]]], capacity: int, seed: int, population: int, offspring: int) -> list[list]:
    """The best grouping an island finds in one epoch. ``elite``: groupings (lists of pieces) that it starts from."""
    rng, n = random.Random(seed), range(len(length))
    people = [[[capacity - sum(length[p] for p in ps), list(ps)] for ps in grouping] for grouping in elite]
    least = -(-sum(length) // capacity)
    while len(people) < population and not any(len(x) <= least for x in people):
        # decreasing length, with some noise for all but the first
        noise = 0.0 if not people else 0.05
        people.append(best_fit(sorted(n, key=lambda p: -length[p] * (1 - noise * rng.random())), length, [], capacity))
    for _ in range(offspring):
        people.sort(key=lambda x: fitness(x, capacity), reverse=True)
        if len(people[0]) <= least:
            break
        people = people[:population]
        a, b = rng.sample(people, 2) if len(people) > 1 else (people[0], people[0])
        people.append(crossover(a, b, length, capacity, rng))
    return max(people, key=lambda x: fitness(x, capacity))


def _epoch(capacity: int, population: int, offspring: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One epoch of one island: rows are the shard's pieces, with the bin of each in the elite it keeps and in the one it gets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "item"]).reset_index(drop=True)
        elite = []
        for column in ("own", "guest"):
            if rows[column].notna().all():
                elite.append([list(x) for x in rows.groupby(column).indices.values()])
        best = evolve(rows["length"].tolist(), elite, capacity, seed + int(rows["shard"].iloc[0]) * 31 + int(rows["island"].iloc[0]), population, offspring)
        at, full = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for b, (free, ps) in enumerate(best):
            at[ps], full[ps] = b, capacity - free
        score = fitness(best, capacity)
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "item", "shard", "island"]].assign(own=at, filled=full, n_bins=-score[0], score=score[1])

    return run


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"
_ISLAND = f"{_PIECE}, shard long, island int, own long, filled long, n_bins long, score double"


def _pack_shards(items: DataFrame, n_shards: int, capacity: int, salt: int, islands: int, population: int, epochs: int, offspring: int) -> DataFrame:
    """Every shard's winner: the rows of ``items`` with shard, own (its bin) and filled (that bin's tokens)."""
    shard = F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece"), F.lit(n_shards))
    state = items.select("*", shard.alias("shard"))
    state = state.select("*", F.explode(F.array(*(F.lit(i) for i in range(islands)))).alias("island"))
    state = state.select("*", F.lit(None).cast("long").alias("own"), F.lit(None).cast("long").alias("guest"))
    for epoch in range(epochs):
        state = state.groupBy("shard", "island").applyInPandas(_epoch(capacity, population, offspring, salt * 1009 + epoch), _ISLAND)
        if epoch < epochs - 1:  # each island's elite goes to the next one
            both = state.select("*", F.array(F.struct(F.col("island").alias("to"), F.lit(True).alias("home")), F.struct(F.pmod(F.col("island") + 1, F.lit(islands)).alias("to"), F.lit(False).alias("home"))).alias("trip"))
            both = both.select("*", F.explode("trip").alias("t"))
            keys = ["doc_id", "piece", "start", "length", "ids_crc32", "item", "shard"]
            state = both.groupBy(*keys, F.col("t.to").alias("island")).agg(F.max(F.when(F.col("t.home"), F.col("own"))).alias("own"), F.max(F.when(~F.col("t.home"), F.col("own"))).alias("guest"))
    state = cut(state, "islands")
    winner = state.groupBy("shard").agg(F.min(F.struct("n_bins", -F.col("score"), "island")).alias("w")).select("shard", F.col("w.island").alias("island"))
    return state.join(winner, ["shard", "island"])


def plan(items: DataFrame, *, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, population: int = POPULATION,
         epochs: int = EPOCHS, offspring: int = OFFSPRING, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (doc_id, piece, start, length, ids_crc32, item) with sequence_id and offset; item is a number of each row's own.

    Every piece is placed once, no sequence holds more than ``capacity`` tokens, and offsets are gapless from 0. Pieces of the
    whole capacity are sequences as they are. Rows that repeat a doc_id and piece are pieces of their own. No rows, no rows.
    After ``rounds`` rounds the bins that are not well filled stay as they are.
    """
    full = items.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"))
    done, rest = [full], items.where(F.col("length") < capacity)
    n = rest.count()
    for r in range(rounds):
        if not n:
            break
        n_shards = max(1, -(-n // shard))
        packed = cut(_pack_shards(rest, n_shards, capacity, r + 1, islands, population, epochs, offspring), "packing")
        last = n_shards == 1 or r == rounds - 1
        closed = packed if last else packed.where(F.col("filled") >= capacity * (1 - WELL_FILLED))
        done.append(closed.select(*items.columns, (F.lit(r << 59) + F.col("shard") * (1 << 20) + F.col("own")).alias("sequence_id")))
        rest = packed.where(F.col("filled") < capacity * (1 - WELL_FILLED)).select(*items.columns)
        n = 0 if last else rest.count()
    placed = reduce(DataFrame.union, done)
    # sequences are bounded by the capacity, so is each of these groups
    group = ["doc_id", "piece", "start", "length", "ids_crc32", "item"]
    listed = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct(*group))).alias("p"))
    before = F.expr("transform(p, (x, i) -> struct(x, aggregate(slice(p, 1, i), 0L, (a, y) -> a + y.length) as offset))")
    return listed.select("sequence_id", F.explode(before).alias("q")).select(*(F.col(f"q.x.{c}").alias(c) for c in group), "sequence_id", F.col("q.offset").alias("offset"))


def pack(docs: DataFrame, *, vocabulary_path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, **tuning) -> DataFrame:
    """Packed sequences of ``docs`` (doc_id, text): sequence_id, ids (at most ``capacity``), and the pieces in them in order
    (doc_id, piece, offset, length). Null texts, repeated rows and empty tables as in ``plan`` and ``pieces``."""
    items = _numbered(pieces(docs, vocabulary_path=vocabulary_path, end_id=end_id, capacity=capacity))
    placed = plan(items.drop("ids"), capacity=capacity, **tuning).select("item", "sequence_id", "offset")
    joined = items.join(placed, "item")
    listed = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("p"))
    return listed.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.expr("transform(p, x -> struct(x.doc_id, x.piece, x.offset, x.length))").alias("pieces"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Pieces with a number of their own, written once so that it stays theirs."""
    return cut(rows.withColumn("item", F.monotonically_increasing_id()), "pieces")


def placements(docs: DataFrame, *, vocabulary_path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, **tuning) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset); see ``pieces`` and ``plan``."""
    items = _numbered(pieces(docs, vocabulary_path=vocabulary_path, end_id=end_id, capacity=capacity, with_ids=False))
    return plan(items, capacity=capacity, **tuning).drop("item")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placements(table(spark, sf_dir, "documents"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
