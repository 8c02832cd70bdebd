"""Components against a direct eigen decomposition, exact deviations, whitened covariance and odd vectors."""

import numpy as np
import pytest

from sonoglyph.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 0) for i, v in rows], SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)


def expected(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(np.array([v for _, v in kept], np.float32).astype(float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return kept, n, ((n * x - s) ** 2).sum(1), c @ (v[:, :8] / np.sqrt(e[:8])), e[:8] / e.sum()


def test_whitened_vectors(spark):
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(500)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (600, None), (601, [None] * 12), (602, [float("nan")] + [0.0] * 11), (603, [float("inf")] + [0.0] * 11), (604, [0.0] * 12), (None, [1.0] * 12)]
    kept, n, deviation, whitened, explained = expected(rows)
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), d) for (i, _), d in zip(kept, deviation.tolist(), strict=True))
    for k in range(8):
        mine = {(r.vec_id, r.deviation): r.whitened for r in got if r.component == k + 1}
        his = {(i, d): w for (i, _), d, w in zip(kept, deviation.tolist(), whitened[:, k].tolist(), strict=True)}
        a, b = np.array([mine[x] for x in his]), np.array(list(his.values()))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert all(abs(r.explained / explained[k] - 1) < 1e-9 for r in got if r.component == k + 1)
    assert max(r.identity_error for r in got) < 1e-9


def test_vectors_without_variance_other_lengths_and_large_entries(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert W.whiten(frame(spark, [(1, [0.5, 0.25])])).count() == 0
    assert W.whiten(frame(spark, [(i, [0.5, 0.25]) for i in range(5)])).count() == 0
    got = W.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0]), (4, [1e38, 0.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 12)) for r in sorted(got)] == [(1, 1, 2, 1024**2, 1.0), (2, 1, 2, 1024**2, 1.0)]
    far = W.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [2.0**40, 1.0]), (3, [2.0**41, 3.0])])).collect()
    assert {r.deviation for r in far if r.vec_id != 2} == {None} and max(r.identity_error for r in far) < 1e-4


@pytest.mark.parametrize("values", [[3.0, 2.0, 1.0, 1.0, 1.0, 0.0], [1.0] * 6, [1e6, 1.0, 1.0 + 1e-9, 1.0 - 1e-9, 1e-9, 1e-12], [0.0] * 6, list(np.logspace(0, -18, 33)), [5.0]])
def test_divide_and_conquer(values):
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(len(values),) * 2))[0]
    a = (q * values) @ q.T
    e, v = W.eigen(a)
    scale = max(max(values), 1e-300)
    assert np.abs(e - sorted(values, reverse=True)).max() < 1e-13 * len(values) * scale
    assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-13 * len(values)
    assert np.abs(a @ v - v * e).max() < 1e-13 * len(values) * scale


def test_polar_factor_has_the_signs():
    a = np.diag([2.0, -1.0, 1e-6, -1e-9])
    assert np.allclose(W.polar_factor(a), np.diag([1.0, -1.0, 1.0, -1.0]), atol=1e-12)
