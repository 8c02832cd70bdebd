"""Inverses of splines, flows and position shifts; decoding as a stream equals decoding a table, over a restart too."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoglyph.functions import flows as X
from sonoglyph.plans.arrays import _samples
from sonoglyph.streaming import decode as S


def test_spline_is_monotonic_and_inverts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *(rng.normal(size=n).tolist() for n in (10, 10, 9)), float(v)) for i, v in enumerate(np.linspace(-6, 6, 201))]
    df = spark.createDataFrame(rows, "id int, w array<double>, h array<double>, d array<double>, x double")
    df = df.withColumn("bins", X.spline_bins(F.col("w"), F.col("h"), F.col("d"), 5.0)).withColumn("y", X.spline(F.col("x"), F.col("bins"), 5.0))
    back = X.spline(F.col("y.value"), F.col("bins"), 5.0, inverse=True)
    out = df.withColumn("back", back).collect()
    assert max(abs(r["back"]["value"] - r["x"]) for r in out) < 1e-9
    assert max(abs(r["back"]["log_det"] + r["y"]["log_det"]) for r in out) < 1e-7
    assert all(r["y"]["value"] == r["x"] and r["y"]["log_det"] == 0 for r in out if abs(r["x"]) > 5)
    one = df.where("id = 0").select("bins", F.explode(F.sequence(F.lit(-500), F.lit(500), F.lit(5))).alias("k")).select("k", X.spline(F.col("k") / 100, F.col("bins"), 5.0)["value"].alias("y")).orderBy("k").collect()
    assert all(a["y"] < b["y"] for a, b in zip(one, one[1:], strict=False))
    assert spark.createDataFrame([], df.schema).select(X.spline(F.col("x"), F.col("bins"), 5.0)).count() == 0


def test_flows_invert(spark):
    df = spark.createDataFrame([([0.5, 2.0, 3.0], [1.0, -1.0, 0.0], [0.1, -2.0, 0.0]), ([], [], []), (None, None, None)], "x array<double>, m array<double>, s array<double>")
    x, m, s = F.col("x"), F.col("m"), F.col("s")
    there = X.affine(X.flip(X.log_flow(x)), m, s)
    back = X.log_flow(X.flip(X.affine(there, m, s, inverse=True)), inverse=True)
    got = [r[0] for r in df.select(back).collect()]
    assert np.allclose(got[0], [0.5, 2.0, 3.0]) and got[1] == [] and got[2] is None
    assert np.isclose(df.limit(1).select(X.log_flow(F.array(F.lit(0.0)))).first()[0][0], np.log(1e-5))


@pytest.mark.parametrize("n", [1, 2, 5])
def test_position_shifts(spark, n):
    x = np.arange(n * n, dtype=float).reshape(n, n)
    df = spark.createDataFrame([(x.tolist(),)], "x array<array<double>>")
    r = df.select(X.relative_positions(F.col("x")), X.absolute_positions(X.relative_positions(F.col("x")))).first()
    assert r[1] == x.tolist() and np.shape(r[0]) == (n, 2 * n - 1)
    assert all(r[0][i][j - i + n - 1] == x[i, j] for i in range(n) for j in range(n))
    keys = np.arange(10, dtype=float).reshape(5, 2)
    scores = df.select(X.banded_scores(F.transform("x", lambda q: F.array(q[0], F.lit(1.0))), F.array(*(F.array(*map(F.lit, k.tolist())) for k in keys)), 2)).first()[0]
    assert scores == [[float(np.dot([x[i, 0], 1.0], keys[j - i + 2])) if abs(j - i) <= 2 else 0.0 for j in range(n)] for i in range(n)]


def test_folding_and_padding(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "x array<double>")
    r = df.select(X.folded(F.col("x"), F.lit(3)), X.folded(F.col("x"), F.lit(5)), X.padded(F.col("x"), 3, True), X.padded(F.col("x"), 4, False), X.padded(F.col("x"), 1, False)).first()
    assert r[0] == [[1.0, 2.0, 3.0], [4.0, 5.0, 4.0]] and r[1] == [[1.0, 2.0, 3.0, 4.0, 5.0]]
    assert r[2] == [0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and r[3] == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 0.0, 0.0] and r[4] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_stream_equals_table_over_a_restart(spark, tmp_path):
    pytest.importorskip("google.protobuf")

    def samples(codes):
        """The same decoder as the query's, in numpy."""
        return np.repeat(codes, 3)[:-2] + np.tile([0.0, 0.25, 0.5], len(codes))[:-2]

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(5)
    rows = [(k, i, float(rng.integers(100))) for k, n in ((1, 80), (2, 24), (3, 7), (4, 61)) for i in range(n)]
    want = {(r["k"], r["chunk"]): (r["phase"], r["n_context"], r["n_new"], r["audio"]) for r in
            S.decode_chunks(spark.createDataFrame(rows, "k long, t long, code double"), "k", "t", 8, _samples, 10).collect() if r["n_new"] == 8}
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for low, high in ((0, 21), (21, 40), (40, 41), (41, 90)):  # a query of its own for each part, from the same checkpoint
        part = [r for r in rows if low <= r[1] < high]
        spark.createDataFrame(part, "k long, t long, code double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k long, t long, code double").parquet(source)
        S.stream_decode_chunks(stream, "k", "t", 8, samples, 10).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = {(r["k"], r["chunk"]): (r["phase"], r["n_context"], r["n_new"], r["audio"]) for r in spark.read.parquet(out).collect()}
    assert got == want and len(got) == 10 + 3 + 7 and os.path.isdir(check)
    assert {p for p, *_ in got.values()} == {1, 2}
