"""Connected components by alternating large-star and small-star steps; nothing but two checksums reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sonoglyph.llm.store import cut, discard


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", "m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (u, v): the smallest id it can reach.

    Each round writes its edges to the shared folder. Loops (u = v), repeated and null edges add nothing; no edges, no rows.
    """
    now = cut(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = None
    while True:
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said == seen or not said[0]:
            break
        before, seen, now = now, said, cut(_small_star(_large_star(now)), "edges")
        discard(before)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
