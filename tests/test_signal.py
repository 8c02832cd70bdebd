"""Kernels along time against direct and exhaustive versions, and their odd inputs."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from sonoglyph.functions import signal as G
from sonoglyph.operators import spans as N


def test_monotonic_path_is_the_best_of_all():
    rng = np.random.default_rng(1)
    for n, t in ((1, 1), (1, 5), (3, 3), (3, 8), (4, 9)):
        value = rng.normal(size=(n, t))
        ways = [np.searchsorted(np.array(cuts), np.arange(t), "right") for cuts in combinations(range(1, t), n - 1)]
        best = max(value[w, np.arange(t)].sum() for w in ways)
        path = G.monotonic_path(value)
        assert path[0] == 0 and path[-1] == n - 1 and set(np.diff(path).tolist()) <= {0, 1}
        assert np.isclose(value[path, np.arange(t)].sum(), best)


def test_log_mel_is_the_direct_transform():
    rng = np.random.default_rng(2)
    x, n, hop, bands, rate = rng.normal(size=100), 16, 4, 5, 4000
    pad = (n - hop) // 2
    padded = np.concatenate([x[1 : pad + 1][::-1], x, x[-pad - 1 : -1][::-1]])
    window = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / n) for i in range(n)])
    filters = G.mel_filters(n, bands, rate, 0.0, rate / 2)
    got = G.log_mel(x, n_fft=n, hop=hop, n_mels=bands, rate=rate)
    assert got.shape == (bands, (len(padded) - n) // hop + 1)
    for f in (0, 3, got.shape[1] - 1):
        frame = padded[f * hop : f * hop + n] * window
        spectrum = [abs(sum(frame[i] * np.exp(-2j * np.pi * k * i / n) for i in range(n))) for k in range(n // 2 + 1)]
        want = np.log(np.maximum(filters @ np.sqrt(np.array(spectrum) ** 2 + 1e-6), 1e-5))
        assert np.allclose(got[:, f], want)
    assert (filters >= 0).all() and (filters.sum(axis=1) > 0).all()


def test_odd_arrays(spark):
    rows = [(1, None, None), (2, [], []), (3, [1.0], [[1.0], [2.0]]), (4, [0.5] * 64, [[1.0, 0.0, 0.0], [0.0, 1.0, 1.0]])]
    df = spark.createDataFrame(rows, "id int, x array<double>, v array<array<double>>")
    got = {r["id"]: r for r in df.select("id", G.mel_spectrum("x", n_fft=16, hop=4, n_mels=3, rate=4000).alias("m"), G.alignment("v").alias("p")).collect()}
    assert all(got[i]["m"] is None and got[i]["p"] is None for i in (1, 2, 3)) and len(got[4]["m"]) == 3 and got[4]["p"] == [0, 1, 1]


def test_splice_and_offsets(spark):
    words = F.expr("array(struct(1 as start, 4 as end, 1 as marks, array('X', 'Y') as instead), struct(5 as start, 6 as end, 0 as marks, cast(null as array<string>) as instead))")
    df = spark.createDataFrame([("abcdefg",)], "t string").select(F.split("t", "").alias("s"), "t")
    assert df.select(F.array_join(N.splice(F.col("s"), words), "")).first()[0] == "aXYdefg"
    assert df.select(F.array_join(N.splice(F.col("s"), F.slice(words, 1, 0)), "")).first()[0] == "abcdefg"
    found = df.select(N.token_offsets(F.col("t"), F.expr("array('bc', 'zz', 'a', 'd', 'd')"))).first()[0]
    assert [(r["token"], r["start"], r["end"]) for r in found] == [("bc", 1, 3), ("d", 3, 4)]
    spans = spark.createDataFrame([(1, "é1 _x, y"), (2, None), (3, "")], "id int, text string")
    assert [(r["word"], r["start"], r["end"]) for r in N.word_offsets(spans, ["id"]).orderBy("start").collect()] == [("é1", 0, 2), ("_x", 3, 5), ("y", 7, 8)]
    ids = {"a": [3], "b": [4, 5]}
    assert df.select(N.mapped_ids(F.expr("array('a', '?', 'b')"), ids)).first()[0] == [1, 0, 3, 0, 4, 5, 0, 2]
    assert df.select(N.mapped_ids(F.expr("array('b')"), ids, pad=[], begin=[9])).first()[0] == [9, 4, 5, 2]


def test_gaussian_alignment_against_all_paths(spark):
    from itertools import combinations

    from sonoglyph.functions import signal as G

    rng = np.random.default_rng(7)
    rows = [(k, *(rng.normal(size=(size, 3)).tolist() for size in (t, n, n))) for k, (n, t) in enumerate([(1, 1), (1, 5), (3, 3), (2, 6), (4, 7), (5, 7), (3, 2), (0, 4)])] + [(8, None, [[0.0] * 3], [[0.0] * 3])]
    kind = "array<array<double>>"
    got = {r["k"]: r["a"] for r in spark.createDataFrame(rows, f"k int, z {kind}, m {kind}, s {kind}").select("k", G.gaussian_alignment("z", "m", "s").alias("a")).collect()}
    for k, z, m, s in rows:
        if z is None or not m or len(z) < len(m):
            assert got[k] is None or got[k]["path"] is None
            continue
        z, m, s = map(np.array, (z, m, s))
        score = np.array([[(-0.5 * np.log(2 * np.pi) - b - 0.5 * (x - a) ** 2 * np.exp(-2 * b)).sum() for x in z] for a, b in zip(m, s, strict=True)])
        assert np.allclose(G.likelihoods(z, m, s), score)
        paths = [np.searchsorted(cuts, np.arange(len(z)), "right") for cuts in combinations(range(1, len(z)), len(m) - 1)]
        best = max(paths, key=lambda p: score[p, np.arange(len(z))].sum())
        assert got[k]["path"] == best.tolist() == G.monotonic_path(score).tolist() and got[k]["durations"] == np.bincount(best, minlength=len(m)).tolist()
    ties = np.zeros((2, 3, 5))
    assert G.monotonic_paths(ties, np.array([3, 2]), np.array([5, 4])).tolist() == [G.monotonic_path(ties[0]).tolist(), [*G.monotonic_path(np.zeros((2, 4))).tolist(), -1]]
