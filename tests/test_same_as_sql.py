"""Queries against their SQL on small tables of rows that are rare in the given ones; the sign of a zero counts."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from sonoglyph.operators import route as O


def same(spark, tmp_path, query: str, table: str, rows: pa.Table) -> list[str]:
    """The rows of a query over one table, after a comparison with DuckDB's."""
    pq.write_table(rows, str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    con.execute(entry.oracle_sql()[query])
    names = [c[0] for c in con.description]
    want = sorted(repr(r) for r in con.fetchall())
    got = sorted(repr(tuple(list(v) if isinstance(v, list) else v for v in r)) for r in entry.queries()[query](spark, str(tmp_path)).select(*names).collect())
    assert got == want
    return got


TINY = [-1e-7, 1e-7, -0.0, 0.0, -4.9999e-7, -5e-7, 5e-7, 0.0078125, -0.0078125, 0.25, -1.5, 3e9, -2.5e-6, float("inf"), float("-inf"), 1.0000005]


def vectors(*values: list[float]) -> pa.Table:
    return pa.table({"vec_id": pa.array(range(len(values)), pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32())), "label": pa.array([0] * len(values), pa.int32())})


def test_interspersed_keeps_the_sign_of_zero(spark, tmp_path):
    got = same(spark, tmp_path, "interspersed", "embeddings", vectors(TINY, [-1e-8, 1e-8], []))
    assert any("-0.0" in r for r in got)


def test_layer_norm_keeps_the_sign_of_zero(spark, tmp_path):
    # the first value becomes -2.0e-07
    got = same(spark, tmp_path, "layer_norm", "embeddings", vectors([-0.111572265625, 1.0, -1.0], [0.5, 0.5], [1.0, 2.0, -4.0]))
    assert any("-0.0" in r for r in got)


def test_empty_texts_are_an_empty_symbol(spark, tmp_path):
    texts = ["", "", None, "a", "a\u0301\U0001f469\u200d\U0001f467", " "]
    got = same(spark, tmp_path, "missing_phonemes", "documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
    assert "('', 2)" in got


def test_repeated_paths_meet_all_their_copies(spark, tmp_path):
    html = ["a", "bb", "bb", "ccc", None, "bb", "a", None, "", "dddd"]
    rows = [(i, [f"u{i % 11}", "u1", None, "u2"][i % 4], html[i % 10]) for i in range(400)]
    table = pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows]), "html": pa.array([r[2] for r in rows])})
    assert len(same(spark, tmp_path, "sync_diff", "pages", table)) == 4


def test_counts_of_actions_are_those_of_pairs(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("x", None), ("y", 1), (None, 3), ("z", None)], "path string, size long")
    b = spark.createDataFrame([("x", 2), ("x", 2), ("x", None), (None, 3), (None, None), ("w", 1), ("v", None)], "path string, size long")
    want = sorted(map(tuple, O.sync_actions(a, b).groupBy("action").count().collect()))
    assert sorted(map(tuple, O.count_actions(a, b).collect())) == want
    assert O.count_actions(a.limit(0), b.limit(0)).count() == 0


def test_gate_keeps_the_sign_of_zero(spark, tmp_path):
    got = same(spark, tmp_path, "tanh_sigmoid_gate", "embeddings", vectors(TINY * 4, [x / 2 for x in TINY[::-1]] * 4))
    assert any("-0.0" in r for r in got)


def test_reference_audio_keeps_the_sign_of_zero(spark, tmp_path):
    got = same(spark, tmp_path, "reference_audio", "embeddings", vectors([-1e-7] * 64, [x for x in TINY if abs(x) < 9] * 4 + [0.5] * 12))
    assert any("-0.0" in r for r in got)
