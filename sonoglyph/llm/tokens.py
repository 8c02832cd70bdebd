"""Token ids of whole texts by a public tokenizer, distinct word by distinct word: its pre-tokenizer never crosses ASCII white space."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from sonoglyph.llm import text as T

#: Distinct units whose ids a task remembers before it starts anew.
REMEMBERED = 600_000
#: Plain words that one call encodes together.
_TOGETHER = 500
#: Marks that always begin a token of their own after a letter.
_MARKS = b".,!?;:|#$%&*"
_LETTER, _MARK, _ELSE = 1, 2, 3
_KIND = np.full(256, _ELSE, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER  # Latin letters; 0xC3 leads U+00C0 to U+00FF
_KIND[list(_MARKS)] = _MARK


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes slices of texts; each distinct unit is encoded once while it is remembered.

    A word of Latin letters and marks after them is two units, its letters in lower case as the tokenizer has them
    anyway, and its marks; any other word is one unit as it stands.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Remembered()

    def _units(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, and each unit's bounds in them, in order."""
        kind = _KIND[s.data]
        cross = np.flatnonzero(s.data == 0xC3)
        cross = cross[cross + 1 < len(s.data)]
        kind[cross[np.isin(s.data[cross + 1], (0x97, 0xB7))]] = _ELSE  # the two signs among those letters
        edge = np.zeros(len(kind) + 1, bool)
        edge[s.offsets] = True
        white = kind == 0
        first, last = np.ones(len(kind), bool), np.ones(len(kind), bool)
        first[1:], last[:-1] = white[:-1], white[1:]
        start = np.flatnonzero(~white & (first | edge[:-1]))
        end = np.flatnonzero(~white & (last | edge[1:])) + 1
        odd = kind == _ELSE
        odd[1:] |= (kind[1:] == _LETTER) & (kind[:-1] == _MARK) & ~edge[1:-1]
        odd = np.concatenate([[0], np.cumsum(odd)])
        whole = odd[end] > odd[start]
        flag = np.zeros(len(kind) + 1, np.int8)
        flag[start[whole]] += 1
        flag[end[whole]] -= 1
        data = np.where(np.cumsum(flag[:-1], dtype=np.int8).astype(bool), s.data, T.fold_ascii(s.data))
        # where letters end and marks begin in a word that is not whole
        marks = np.zeros(len(kind), bool)
        marks[1:] = (kind[1:] == _MARK) & (kind[:-1] == _LETTER)
        cut = np.flatnonzero(marks)
        at = np.searchsorted(start, cut, "right") - 1
        cut = cut[~whole[at] & (cut > start[at])] if len(cut) else cut
        return data, np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))

    def _encode(self, units: list[str]) -> list[np.ndarray]:
        out: dict[int, np.ndarray] = {}
        plain = [i for i, u in enumerate(units) if u.isalpha()]
        groups = [plain[i : i + _TOGETHER] for i in range(0, len(plain), _TOGETHER)]
        for group, found in zip(groups, self.tokenizer.encode_batch([" ".join(units[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            cuts = np.flatnonzero(np.diff(np.array(found.word_ids, np.int64))) + 1
            if len(cuts) + 1 == len(group):
                out |= zip(group, np.split(np.array(found.ids, np.uint32), cuts), strict=True)
        rest = [i for i in range(len(units)) if i not in out]
        for i, found in zip(rest, self.tokenizer.encode_batch([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, np.uint32)
        return [out[i] for i in range(len(units))]

    def encode(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and the bounds of each text's."""
        data, start, end = self._units(s)
        ids, bounds = self.known.ids_of(data, start, end, lambda units: self._encode([u.decode("utf-8", "replace") for u in units]))
        return ids, bounds[np.searchsorted(start, s.offsets)]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker: what it remembers serves the next one."""
    return WordEncoder(path)


class Remembered:
    """Ids of distinct byte strings, by the bytes themselves; hashes only find equal ones together."""

    def __init__(self) -> None:
        self.row: dict[bytes, int] = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, encode: Callable[[list[bytes]], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units of ``data``, and the bounds of each unit's; ``encode`` gets those not seen before."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        _, first, unit = np.unique(T.spans_hash(data, start, end), return_index=True, return_inverse=True)
        if not T.spans_equal(data, start, end, start[first[unit]], end[first[unit]]).all():  # different units of one hash
            first = unit = np.arange(len(start))
        if len(self.row) > REMEMBERED:
            self.__init__()
        raw = data.tobytes()
        units = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        fresh = list(dict.fromkeys(u for u in units if u not in self.row))
        if fresh:
            found = encode(fresh)
            size = np.array([len(x) for x in found], np.int64)
            self.row.update(zip(fresh, range(len(self.row), len(self.row) + len(fresh)), strict=True))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, *found])
        at = np.array([self.row[u] for u in units], np.int64)[unit]
        size = self.size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])], total
