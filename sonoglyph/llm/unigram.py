"""Operator 3, SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

White space becomes the marker U+2581, one more stands before the text. No piece has a marker after another character,
so the best path of a text is that of its units, each markers and what follows them up to the next ones. All distinct
units of a slice are encoded together: the trie is walked from every character at once, and the best paths are extended
one end at a time for all units. What no piece covers falls back to its UTF-8 bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sonoglyph.llm import text as T
from sonoglyph.llm.store import table
from sonoglyph.llm.tokens import Remembered, vocabulary

MODEL = "piece_bpe_32k.model"
MARKER = "▁".encode()
#: Distinct units whose paths are found together.
UNITS = 4096
#: How far below the least score an unknown character is.
UNKNOWN_PENALTY = 10.0


@dataclass
class Trie:
    """Double array: from state s byte c leads to ``base[s] + c`` if ``check`` there is s; ``value`` is a piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(pieces: dict[bytes, int]) -> Trie:
    children: list[dict[int, int]] = [{}]
    ids = [-1]
    for piece, id_ in pieces.items():
        node = 0
        for c in piece:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ids.append(-1)
            node = children[node][c]
        ids[node] = id_
    size = 2 * len(children) + 512
    base, check, value, free, lowest = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), bytearray(b"\1" * size), 1
    free[0] = 0
    value[0] = ids[0]
    queue = [(0, 0)]
    for node, state in queue:
        if not (kids := children[node]):
            continue
        low, most = min(kids), max(kids)
        at = max(lowest - low, 1)
        while True:
            at = free.find(1, at + low) - low
            if at + low < 0 or at + most >= size:
                grow = size
                base, check, value = np.concatenate([base, np.zeros(grow, np.int32)]), np.concatenate([check, np.full(grow, -1, np.int32)]), np.concatenate([value, np.full(grow, -1, np.int32)])
                free += b"\1" * grow
                at, size = max(1, size - 256), size + grow
                continue
            if all(free[at + c] for c in kids):
                break
            at += 1
        base[state] = at
        for c, kid in kids.items():
            free[at + c], check[at + c], value[at + c] = 0, state, ids[kid]
            queue.append((kid, at + c))
        if len(kids) == 1:
            lowest = max(lowest, free.find(1, lowest))
    return Trie(base, check, value)


@dataclass
class Model:
    """Pieces of a model: trie, log score by id, the ids of the 256 bytes, and what each id decodes to."""

    trie: Trie
    score: np.ndarray
    byte_ids: np.ndarray
    text: list[bytes]


def load_model(path: str) -> Model:
    """Pieces of a SentencePiece model file. Log scores are taken as they are; a file of merge ranks instead (whole numbers
    from 0 down, one a piece) gets those of Zipf's law, ``-ln(rank + 1) - ln(sum of 1 / rank)``."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    score = np.array([m.get_score(i) for i in range(m.vocab_size())], np.float32)
    ranks = -score[ids]
    if (ranks == np.round(ranks)).all() and len(np.unique(ranks)) > len(ids) // 2:
        order = np.arange(1, len(ids) + 1)
        score[ids] = (-np.log(order) - np.log((1 / order).sum())).astype(np.float32)
    return make_model({m.id_to_piece(i).encode(): i for i in ids}, score, np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32))


def make_model(pieces: dict[bytes, int], score: np.ndarray, byte_ids: np.ndarray) -> Model:
    if any(MARKER in _after(p) for p in pieces):
        raise ValueError("a piece has a white-space marker after another character")
    text = [b""] * len(score)
    for b, i in enumerate(byte_ids):
        text[i] = bytes([b])
    for p, i in pieces.items():
        text[i] = p.replace(MARKER, b" ")
    used = np.zeros(len(score), bool)
    used[list(pieces.values())] = True
    return Model(build_trie(pieces), np.where(used, score, np.float32(0)), byte_ids, text)


def _after(piece: bytes) -> bytes:
    while piece.startswith(MARKER):
        piece = piece[len(MARKER) :]
    return piece


def viterbi(model: Model, units: list[bytes]) -> list[np.ndarray]:
    """The ids of each unit's best path; of equal scores the one with the longer last piece."""
    size = np.array([len(u) for u in units], np.int64)
    data = np.frombuffer(b"".join(units), np.uint8).astype(np.int64)
    first = np.cumsum(size) - size
    stop = np.repeat(first + size, size)
    char = np.flatnonzero((data & 0xC0) != 0x80)
    next_char = np.append(char[1:], len(data))
    t, used = model.trie, model.score
    at, state, end = char, np.zeros(len(char), np.int64), char.copy()
    starts, ends, ids = [], [], []
    while len(at):
        to = t.base[state] + data[end]
        ok = (to < len(t.check)) & (t.check[np.minimum(to, len(t.check) - 1)] == state) & (t.base[state] > 0)
        at, state, end = at[ok], to[ok], end[ok] + 1
        hit = t.value[state] >= 0
        starts.append(at[hit]), ends.append(end[hit]), ids.append(t.value[state[hit]])
        more = end < stop[at]
        at, state, end = at[more], state[more], end[more]
    starts, ends, ids = (np.concatenate(x) for x in (starts, ends, ids))
    # a character that no piece is alone is unknown
    length = np.zeros(len(data) + 1, np.int64)
    length[char] = next_char - char
    alone = np.zeros(len(data) + 1, bool)
    alone[starts[ends - starts == length[starts]]] = True
    lone = char[~alone[char]]
    least = used.min()
    starts, ends = np.concatenate([starts, lone]), np.concatenate([ends, lone + length[lone]])
    ids = np.concatenate([ids.astype(np.int64), np.full(len(lone), -1)])
    score = np.where(ids >= 0, used[ids].astype(np.float64), float(least) - UNKNOWN_PENALTY)
    unit = np.repeat(np.arange(len(units)), size)[starts]
    order = np.lexsort((starts, unit, ends - first[unit]))
    starts, ends, ids, score, unit = starts[order], ends[order], ids[order], score[order], unit[order]
    best = np.zeros(len(data) + len(units))  # place p of unit u is at p + u
    back = np.full(len(data) + len(units), -1, np.int64)
    offset = ends - first[unit]
    cuts = np.append(np.flatnonzero(np.append(True, offset[1:] != offset[:-1])), len(offset))
    for a, b in zip(cuts, cuts[1:], strict=False):
        total = best[starts[a:b] + unit[a:b]] + score[a:b]
        head = np.flatnonzero(np.append(True, unit[a + 1 : b] != unit[a : b - 1]))
        top = np.maximum.reduceat(total, head)
        won = np.flatnonzero(total == np.repeat(top, np.diff(np.append(head, b - a))))
        won = won[np.append(True, unit[a + won][1:] != unit[a + won][:-1])]
        place = ends[a + won] + unit[a + won]
        best[place], back[place] = total[won], a + won
    # back along all paths together
    here, who, steps = first + size + np.arange(len(units)), np.arange(len(units)), []
    live = size > 0
    here, who = here[live], who[live]
    while len(here):
        edge = back[here]
        steps.append((who, edge))
        here = starts[edge] + who
        on = starts[edge] > first[who]
        here, who = here[on], who[on]
    if not steps:
        return [np.zeros(0, np.uint32) for _ in units]
    who, edge = (np.concatenate([s[i] for s in steps[::-1]]) for i in (0, 1))
    order = np.argsort(who, kind="stable")
    who, edge = who[order], edge[order]
    # an unknown character becomes its bytes
    width = np.where(ids[edge] >= 0, 1, ends[edge] - starts[edge])
    out = np.repeat(ids[edge], width)
    begin = np.cumsum(width) - width
    unknown = np.flatnonzero(out < 0)
    rank = np.repeat(np.arange(len(edge)), width)[unknown]
    out[unknown] = model.byte_ids[data[starts[edge[rank]] + unknown - begin[rank]]]
    counts = np.bincount(who, width, minlength=len(units)).astype(np.int64)
    return np.split(out.astype(np.uint32), np.cumsum(counts)[:-1])


class UnigramCodec:
    def __init__(self, model: Model):
        self.model, self.known = model, Remembered()
        self.width = np.array([len(x) for x in model.text], np.int64)
        self.at = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(model.text), np.uint8)
        self.is_byte = np.isin(np.arange(len(model.text)), model.byte_ids)

    def encode(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and the bounds of each text's; an empty text has none."""
        full = np.flatnonzero(np.diff(s.offsets) > 0)
        data = np.insert(s.data, s.offsets[full], 32)
        offsets = s.offsets + np.searchsorted(s.offsets[full], s.offsets, "left")
        space = data == 32
        before = np.zeros(len(data), bool)
        before[1:] = space[:-1]
        before[offsets[:-1][np.diff(offsets) > 0]] = False
        start = np.flatnonzero(space & ~before)
        end = np.append(start[1:], len(data))[: len(start)]
        ids, bounds = self.known.ids_of(data, start, end, lambda units: [
            ids for i in range(0, len(units), UNITS) for ids in viterbi(self.model, [u.replace(b" ", MARKER) for u in units[i : i + UNITS]])])
        return ids, bounds[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of all texts, each without the marker that stands before it, and the bounds of each text's."""
        width = self.width[ids]
        total = np.concatenate([[0], np.cumsum(width)])
        data = self.flat[np.repeat(self.at[ids] - total[:-1], width) + np.arange(total[-1])]
        offsets = total[bounds]
        full = np.diff(offsets) > 0
        first = offsets[:-1][full]
        first = first[data[first] == 32]
        return np.delete(data, first), offsets - np.searchsorted(first, offsets, "left")


def _encode(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = UnigramCodec(sent.value)
        for batch in batches:
            for s in T.slices(batch.column("text")):
                ids, bounds = codec.encode(s)
                data, offsets = codec.decode(ids, bounds)
                pieces = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                text = pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)], pa.string())
                fell = np.concatenate([[0], np.cumsum(codec.is_byte[ids])])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.n_docs), pieces, pa.array(np.diff(fell[bounds])), text], ["doc_id", "ids", "n_byte_pieces", "decoded"])

    return run


def _digest(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    inner = _encode(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column("text").fill_null(""), 0
            for out in inner(iter([batch])):
                ids, n = out.column("ids"), out.num_rows
                bounds, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
                same = [a == b for a, b in zip(out.column("decoded").to_pylist(), texts.slice(at, n).to_pylist(), strict=True)]
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
                at += n
                yield pa.RecordBatch.from_arrays([out.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), out.column("n_byte_pieces"), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"])

    return run


def encode(docs: DataFrame, *, model: Model | None = None) -> DataFrame:
    """(doc_id, ids, n_byte_pieces, decoded) of every row of ``docs`` (doc_id, text): its pieces, those of them that are
    bytes, and the text that they decode to. It is the text itself, but that U+2581 in it becomes a space.

    Null and empty texts have no piece and decode to an empty text. Repeated rows each give a row; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or load_model(vocabulary(MODEL)))
    return docs.select("doc_id", "text").mapInArrow(_encode(sent), "doc_id long, ids array<int>, n_byte_pieces long, decoded string")


def op3_unigram_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = spark.sparkContext.broadcast(load_model(vocabulary(MODEL)))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_digest(sent), "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")


QUERIES = {"op3_unigram_viterbi": op3_unigram_viterbi}
ORACLE_SQL: dict[str, str] = {}
