"""Operator 12, periodic run detection: Kruskal over the suffixes of each document in the order of falling common prefixes.

A run is a stretch of consecutive words with smallest period q and at least ``max(MIN_LENGTH, MIN_EXPONENT * q)`` words that
no neighbouring word extends. The suffixes of a document's words are ranked by prefix doubling; neighbours in that order,
with their longest common prefixes, are edges. Taken by falling prefix, edges unite classes of suffixes that share so many
words; each class keeps its positions in order. Two positions that become neighbours within a class at prefix l, and lie
no further apart than l, seed a run whose period is their distance: nothing between them shares l words with them, so that
the distance is the smallest period. A seed that cannot be extended to the left starts a run, which is l words and a period long.

A run's start shares at least ``MIN_EXPONENT - 1`` periods, so only suffixes that share ``LEAST_PREFIX`` words with another
one of their document become edges; in ordinary text these are few. Documents are independent: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sonoglyph.llm.store import table
from sonoglyph.llm.text import mix, slices, words

#: Words that a run has at least.
MIN_LENGTH = 6
#: Periods that a run has at least.
MIN_EXPONENT = 4
#: Words that a run's start shares with the place one period further on: the length less a period.
LEAST_PREFIX = MIN_LENGTH - MIN_LENGTH // MIN_EXPONENT

_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted_source(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original word at each place, or None where all stay: a tenth of the documents, by a hash of the decimal doc_id,
    repeat the words from a place on."""
    if doc_id is None or not n:
        return None
    tens, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    first = tens % n
    period = 1 + (n - first) // (3 + tens % 8)
    at = np.arange(n)
    at[first:] = first + (at[first:] - first) % period
    return at


def _resort(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places ``of`` in the order of their keys, where in it each key begins, and which of them share theirs."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.ones(len(of), bool)
    starts[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(starts)
    group = np.cumsum(starts) - 1
    return of[order], first[group], np.diff(np.append(first, len(of)))[group] > 1


def suffix_order(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Of words ``ids`` of documents ``doc`` (not falling): places whose suffix shares LEAST_PREFIX words or more with another of
    the document, in the order of the suffix array; their common prefix with the one before (0 where a class begins); and
    the ranks by the first 1, 2, 4 ... words.

    Ranks are places in one order of all suffixes (words by their hashes), equal for equal prefixes within a document. A suffix
    that shares its rank with no other is settled.
    """
    n = len(ids)
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1
    end = np.repeat(last, np.diff(last, prepend=0))
    rank = np.empty(n, np.int64)
    of, new, shared = _resort(mix(ids + mix(doc.astype(np.uint64))), np.arange(n))
    rank[of] = new
    levels, size, open_ = [(1, rank.astype(np.uint32))], 1, of[shared]
    while len(open_):
        ahead = open_ + size
        inside = ahead < end[open_]
        follow = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        of, new, shared = _resort(rank[open_].astype(np.uint64) << np.uint64(32) | follow.astype(np.uint64), open_)
        # a class keeps its places in the order: those of its members, counted from its first
        opens = np.ones(len(of), bool)
        opens[1:] = rank[of[1:]] != rank[of[:-1]]
        rank[of] = rank[of] + new - np.flatnonzero(opens)[np.cumsum(opens) - 1]
        size *= 2
        levels.append((size, rank.astype(np.uint32)))
        open_ = of[shared]
    places = np.flatnonzero(_in_class(levels, n))
    places = places[np.argsort(rank[places], kind="stable")]
    common = np.zeros(len(places), np.int64)
    common[1:] = common_prefix(levels, end, places[:-1], places[1:])
    common[common < LEAST_PREFIX] = 0
    return places, common, levels


def _in_class(levels: list[tuple[int, np.ndarray]], n: int) -> np.ndarray:
    """Which places share the longest level up to LEAST_PREFIX words with another place."""
    known = [r for size, r in levels if size <= LEAST_PREFIX][-1]
    return np.bincount(known, minlength=n)[known] > 1


def common_prefix(levels: list[tuple[int, np.ndarray]], end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` share, by halving: equal ranks are equal prefixes."""
    done = np.zeros(len(a), np.int64)
    same = end[a] == end[b]
    for size, rank in reversed(levels):
        x, y = a + done, b + done
        go = np.flatnonzero(same & (np.maximum(x, y) + size <= end[a]))
        done[go[rank[x[go]] == rank[y[go]]]] += size
    return done


def _united(low: list[int], high: list[int], prefix: int, seeds: list[tuple[int, int, int]]) -> list[int]:
    """The positions of both classes in order; those that become neighbours and are no further apart than ``prefix`` are seeds."""
    small, large = (low, high) if len(low) < len(high) else (high, low)
    fresh = set(small)
    if len(small) * 16 < len(large):
        for x in small:
            insort(large, x)
        for x in small:
            k = bisect_left(large, x)
            for i, j in ((k - 1, k), (k, k + 1)):
                if 0 <= i and j < len(large) and large[j] - large[i] <= prefix and not (large[i] in fresh and large[j] in fresh):
                    seeds.append((large[i], large[j], prefix))
        return large
    both = sorted(large + small)
    for x, y in zip(both, both[1:], strict=False):
        if y - x <= prefix and (x in fresh) != (y in fresh):
            seeds.append((x, y, prefix))
    return both


def seeds_of(places: np.ndarray, common: np.ndarray) -> np.ndarray:
    """(left, right, prefix) of each two positions that become neighbours: edges by falling prefix, classes by union-find."""
    edges = np.flatnonzero(common)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    seeds: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b, prefix in zip(places[edges - 1].tolist(), places[edges].tolist(), common[edges].tolist(), strict=True):
        a, b = root(a), root(b)
        one, two = members.pop(a, None) or [a], members.pop(b, None) or [b]
        keep, goes = (a, b) if len(one) >= len(two) else (b, a)
        parent[goes] = keep
        members[keep] = _united(one, two, prefix, seeds)
    return np.array(seeds, np.int64).reshape(-1, 3)


def find_runs(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (first word, length, period) of all runs of the documents, places counted over all of them, by first word and period."""
    none = np.zeros((0, 3), np.int64)
    if len(ids) < MIN_LENGTH:
        return none
    if len(ids) >= 1 << 32:
        raise ValueError("a text of 2^32 words or more")
    places, common, _ = suffix_order(ids, doc)
    left, right, prefix = seeds_of(places, common).T
    period = right - left
    fits = (prefix + period >= MIN_LENGTH) & (prefix >= (MIN_EXPONENT - 1) * period)
    left, right, prefix, period = left[fits], right[fits], prefix[fits], period[fits]
    before = np.maximum(left - 1, 0)
    starts = (left == 0) | (doc[before] != doc[left]) | (ids[before] != ids[right - 1])
    runs = np.stack([left, prefix + period, period], 1)[starts]
    if not len(runs):
        return none
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # positions of one prefix can be neighbours for a moment, until a third one comes between: of one stretch the smallest period counts
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _digest(doc_id: int | None, runs: np.ndarray, tokens: list[bytes], source: np.ndarray | None) -> tuple:
    if not len(runs):
        text = tokens if source is None else [tokens[i] for i in source.tolist()]
        return doc_id, 0, None, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(b" ".join(text)).hexdigest()
    gone = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    collapsed = b" ".join([tokens[i] for i in (kept if source is None else source[kept]).tolist()])
    start, length, period = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
    return (doc_id, len(runs), start, length, period, 1000 * length // period,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())


def _scan(planted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for s in slices(batch.column(1)):
                w = words(s, lower=False)
                source = np.arange(len(w.doc))
                own: list[np.ndarray | None] = []
                for d in range(s.n_docs):
                    own.append(planted_source(doc_ids[s.first + d], int(w.bounds[d + 1] - w.bounds[d])) if planted else None)
                    if own[-1] is not None:
                        source[w.bounds[d] : w.bounds[d + 1]] = w.bounds[d] + own[-1]
                runs = find_runs(w.hash[source], w.doc)
                bounds = np.searchsorted(runs[:, 0], w.bounds)
                for d in range(s.n_docs):
                    found = runs[bounds[d] : bounds[d + 1]].copy()
                    found[:, 0] -= w.bounds[d]
                    tokens = s.data[s.offsets[d] : s.offsets[d + 1]].tobytes().split()
                    rows.append(_digest(doc_ids[s.first + d], found, tokens, own[d]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i > 5 else pa.int64()) for i in range(8)],
                                             names=[x.split()[0] for x in _SCHEMA.split(", ")])
    return run


def periodic_runs(docs: DataFrame, *, planted: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_runs, the longest run (ties: smallest start, then period; four nulls
    without one), SHA-256 of all runs as lines ``start,length,period``, and of the text without what runs repeat.

    ``planted`` first repeats words of some documents, see ``planted_source``. A null or blank text has no words: no run, and
    the digests of nothing; a null doc_id is never planted. Repeated rows each give a row; other columns are not read; no
    rows, no rows. Words are told by 64-bit hashes. A text is worked on whole, in memory in proportion to its words and the
    logarithm of its longest repeat.
    """
    return docs.select("doc_id", "text").mapInArrow(_scan(planted), _SCHEMA)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True)


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLE_SQL: dict[str, str] = {}
