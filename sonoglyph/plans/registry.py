"""How a module of queries is built up: each query with its SQL, or without where SQL cannot express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_string(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_rows(rows: list[tuple]) -> str:
    """Rows of a VALUES list."""
    return ", ".join("(" + ", ".join(sql_string(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
