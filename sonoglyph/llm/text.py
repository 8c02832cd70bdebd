"""Vectorised word kernels that run inside Arrow batches.

Words are maximal runs of bytes other than space and ``\\t\\n\\v\\f\\r``; texts are whole, a null text has no words.
Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Text bytes that one kernel call takes; a longer text is one call of its own.
SLICE_BYTES = 1 << 20
#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 256
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Some texts of a batch: ``first`` is the row of the first one, ``offsets`` bound each text in ``data``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = texts.buffers()
    kind = np.int64 if texts.type == pa.large_string() else np.int32
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return bounds, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of an Arrow column, null as empty, in runs of about ``most`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type not in (pa.string(), pa.large_string()):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    bounds, raw = _buffers(texts)
    if texts.null_count and np.diff(bounds)[np.asarray(texts.is_null())].any():
        bounds, raw = _buffers(texts.fill_null(""))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield Slice(at, raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to


@dataclass
class Words:
    """Words of a slice in order: text, byte bounds and hash of each; ``bounds[d]:bounds[d+1]`` are those of text d."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; beyond the end there are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte span: its 8-byte lanes are mixed in one after another; long spans are hashed by xxh3."""
    lanes, size = _lanes(data), end - start
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    go = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at = 0
    while len(go):
        left = size[go] - at
        out[go] = mix(out[go] ^ (lanes[start[go] + at] & _KEEP[np.minimum(left, 8)]))
        go, at = go[left > 8], at + 8
    for i in np.flatnonzero(size > LONG_SPAN):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def spans_equal(data: np.ndarray, start: np.ndarray, end: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether each byte span holds the same bytes as its other one."""
    lanes, size = _lanes(data), end - start
    out = size == other_end - other_start
    go = np.flatnonzero(out & (start != other_start))
    at = 0
    while len(go):
        left = size[go] - at
        keep = _KEEP[np.clip(left, 0, 8)]
        same = (lanes[start[go] + at] & keep) == (lanes[other_start[go] + at] & keep)
        out[go[~same]] = False
        go, at = go[same & (left > 8)], at + 8
    return out


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(s: Slice, lower: bool = True) -> Words:
    data = fold_ascii(s.data) if lower else s.data
    word = ~is_space(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[s.offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = ~word[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = ~word[1:]
    start = np.flatnonzero(word & (before | edge[:-1]))
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    doc = np.searchsorted(s.offsets, start, "right") - 1
    return Words(doc, start, end, spans_hash(data, start, end), np.searchsorted(doc, np.arange(s.n_docs + 1)))


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word's index and the hash of each run of n words in one text."""
    count = len(w.doc) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = w.hash[:count].copy()
    for i in range(1, n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + w.hash[i : i + count]
    at = np.flatnonzero(w.doc[:count] == w.doc[n - 1 :])
    return at, mix(total[at])


def shingle_sets(s: Slice, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingles of each text; a text of fewer words has its whole sequence as one, one without words none."""
    w = words(s)
    at, grams = ngrams(w, size)
    bounds = np.searchsorted(w.doc[at], np.arange(s.n_docs + 1))
    for d in range(s.n_docs):
        if bounds[d] < bounds[d + 1]:
            yield s.first + d, np.unique(grams[bounds[d] : bounds[d + 1]])
        else:
            few = w.hash[w.bounds[d] : w.bounds[d + 1]]
            total = np.uint64(len(few))
            with np.errstate(over="ignore"):
                for h in few:
                    total = total * np.uint64(0xD6E8FEB86659FD93) + h
            yield s.first + d, mix(np.array([total], np.uint64)) if len(few) else np.zeros(0, np.uint64)
