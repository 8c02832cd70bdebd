"""Ordered steps in chunks: over a finished table by windows, over a stream by keyed state; both give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def chunks(steps: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """(key, chunk, n_steps, total, is_final): full chunks of a size, and a last partial one, which alone is final."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = steps.withColumn("chunk", F.floor(at / size).cast("long"))
    out = rows.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("n_steps"), F.sum("value").alias("value"))
    return out.select(key, "chunk", "n_steps", (F.col("chunk") * size + F.col("n_steps")).alias("total"), (F.col("n_steps") < size).alias("is_final"), "value")


def stream_chunks(steps: DataFrame, key: str, size: int) -> DataFrame:
    """Full chunks of a stream of steps (key, order, value), as they fill up; the state of a key is fewer than ``size`` steps."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values("order")
        held = [*held, *rows["value"].tolist()]
        while len(held) >= size:
            part, held = held[:size], held[size:]
            yield pd.DataFrame({key: [keys[0]], "chunk": [done], "n_steps": [size], "value": [sum(part)]})
            done += 1
        state.update((done, held))

    out = f"{key} long, chunk long, n_steps long, value double"
    return steps.groupBy(key).applyInPandasWithState(run, out, "done long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def sliding_context(steps: DataFrame, key: str, order: str, context: int) -> DataFrame:
    """Adds ctx, the number of steps before each one within the context, and ctx_value, their sum."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(-context, -1)
    return steps.withColumn("ctx", F.count(F.lit(1)).over(before)).withColumn("ctx_value", F.coalesce(F.sum("value").over(before), F.lit(0.0)))


def queue(requests: DataFrame, server: str) -> DataFrame:
    """One server, first come first served: adds begin, finish and waiting (requests ahead in the system) to ``requests``
    (server, request, arrival, work).

    The finish of the n-th request is the greatest, over all before it, of an arrival plus the work from there on.
    """
    order = Window.partitionBy(server).orderBy("arrival", "request").rowsBetween(Window.unboundedPreceding, 0)
    summed = requests.withColumn("_w", F.sum("work").over(order))
    finish = F.max(F.col("arrival") + F.col("work") - F.col("_w")).over(order) + F.col("_w")
    timed = summed.withColumn("finish", finish).withColumn("begin", F.col("finish") - F.col("work")).drop("_w")
    return timed
