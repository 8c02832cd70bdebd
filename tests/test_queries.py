"""Every query of the main library that has SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _main():
    import importlib

    found = {}
    for name in entry.MODULES:
        m = importlib.import_module(f"sonoglyph.{name}")
        found |= {k: (f, m.ORACLE_SQL.get(k)) for k, f in m.QUERIES.items()}
    return found


MAIN = _main()


def norm(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 6))
    return "null" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(MAIN))
def test_query(spark, duck, name):
    f, sql = MAIN[name]
    df = f(spark, SF)
    columns = sorted(df.columns)
    got = sorted("|".join(norm(r[c]) for c in columns) for r in df.collect())
    if sql is None:
        assert got
        return
    r = duck.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    want = sorted("|".join(norm(row[names.index(c)]) for c in columns) for row in r.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0 or not os.path.isdir(SF)
