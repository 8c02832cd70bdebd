"""Runs against brute force, the digests, planted documents and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from sonoglyph.llm import periodic_runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = hashlib.sha256().hexdigest()


def brute(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            size = e + q - s
            if size >= max(6, 4 * q) and not any(all(w[i] == w[i + p] for i in range(s, s + size - p)) for p in range(1, q)):
                out.append((s, size, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, planted):
    w = WORD.findall(text or "")
    if planted and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def phrases(rng, n):
    w = []
    while len(w) < n:
        w += [f"w{rng.randrange(rng.choice((2, 3, 40)))}" for _ in range(rng.randrange(1, 7))] * rng.choice((1, 1, 2, 4, 5, 7))
    return w


def test_odd_rows_and_random_documents(spark, docs):
    rng = random.Random(12)
    rows = [(None, "a a a a a a"), (1, None), (2, ""), (3, " \n\t "), (4, "a " * 5), (5, "a " * 6), (6, "a b " * 4), (6, "a b " * 4), (7, "é é " * 9 + "é"),
            (8, "a b a b a b a c c c c c c"), (9, "x\x1cy " * 6)] + [(100 + i, " \n".join(phrases(rng, rng.randrange(90)))) for i in range(200)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i) > 10
    for planted in (False, True):
        got = R.periodic_runs(docs(rows), planted=planted).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected(*r, planted)) for r in rows)
    assert got[0].asDict().keys() == {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}
    assert {(r.runs_sha256, r.collapsed_sha256) for r in R.periodic_runs(docs([(1, None)])).collect()} == {(EMPTY, EMPTY)}
    assert R.periodic_runs(docs([])).count() == 0


def test_very_long_texts(spark, docs):
    rows = [(i, t) for i, t in enumerate(["word " * 300_000, "one two three " * 100_000, " ".join(f"w{i}" for i in range(200_000))])]
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period) for r in R.periodic_runs(docs(rows)).collect()}
    assert got == {0: (1, 0, 300_000, 1), 1: (1, 0, 300_000, 3), 2: (0, None, None, None)}


def test_documents_do_not_run_into_each_other():
    ids = np.full(10, 7, np.uint64)
    assert R.find_runs(ids, np.repeat([0, 1], 5)).tolist() == []
    assert R.find_runs(ids, np.repeat([0, 1], [4, 6])).tolist() == [[4, 6, 1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4))
def test_any_words(texts):
    ids = np.array([x for w in texts for x in w], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
    want, before = [], 0
    for w in texts:
        want += [[a + before, b, c] for a, b, c in brute(w)]
        before += len(w)
    assert R.find_runs(ids, doc).tolist() == want
