"""Vectors with a direction in common, of several lengths, and samples without a usable row."""

import numpy as np
import pytest

from sonoglyph.llm import itq


@pytest.mark.parametrize("common", [0.0, 0.5, 0.8])
def test_recall_and_cost_with_a_common_direction(common):
    rng = np.random.default_rng(8)
    d, n = 64, 20_000
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    axis = np.eye(d)[0]
    x = unit(np.sqrt(common) * axis + np.sqrt(1 - common) * unit(rng.normal(size=(n, d))))
    mean = x[:5000].mean(axis=0)
    bits, tables = itq.tables_for(float(mean @ mean))
    rotations = itq.learn_rotations(x[:5000] - mean, bits * tables)
    for cosine, least in ((0.951, 0.97), (0.96, 0.98), (0.97, 0.99)):
        y = unit(x + 0.0)
        other = unit(rng.normal(size=(n, d)))
        # at the wanted cosine, and about as far along the common direction
        other -= (other * y).sum(1, keepdims=True) * y
        other -= (other @ axis)[:, None] * axis * (common > 0)
        other -= (other * y).sum(1, keepdims=True) * y
        y = cosine * y + np.sqrt(1 - cosine**2) * unit(other)
        keys, those = (itq.codes(v, rotations, bits, mean) for v in (x, y))
        assert (keys == those).any(axis=1).mean() > least
    cosines = sum(float((np.bincount(keys[:, t]).astype(float) ** 2).sum()) for t in range(tables))
    assert cosines < 0.05 * n * n


def test_several_lengths_and_rows_that_are_not_usable(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 12)), rng.normal(size=(30, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(a)] + [(100 + i, v.tolist()) for i, v in enumerate(b)]
    rows += [(200, (a[0] + 1e-6).tolist()), (201, (b[0] * 3).tolist()), (202, b[0].tolist()), (300, [0.0] * 12), (301, None), (302, [float("inf")] * 12), (303, []), (304, [None] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for block in (4, 512):
        got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_vectors(df, block=block).collect()}
        assert got[200] == (1, 0) and got[0] == (1, 0) and got[100] == got[201] == got[202] == (2, 100)
        assert len(got) == len(rows) and all(got[i] == (0, i) for i in range(300, 305))
    # of the first rows by hash none is usable
    zero = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(30)] + [(100, [1.0, 2.0]), (101, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.n_links) for r in itq.near_vectors(zero, sample=2).collect() if r.n_links} == {(100, 1), (101, 1)}
    # all in one bucket where keys save nothing
    near = np.eye(8)[0] + 1e-3 * rng.normal(size=(50, 8))
    same = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in itq.near_vectors(same, block=16).collect()} == {(49, 0)}
    assert itq.tables_for(0.94) == (0, 1) and itq.tables_for(0.0005) == (16, 20)
