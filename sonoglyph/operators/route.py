"""Lookups as joins: speakers, models, locales, thresholds, manifests. Dimension sides are configuration, a few rows each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sonoglyph.dims import CONFUSABLE, DEFAULT_THRESHOLD, SCRIPT_LANGUAGES, SCRIPT_THRESHOLDS


def first_wins(df: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def build_routes(models: DataFrame) -> DataFrame:
    """(speaker, model, speaker_id) of ``models`` (model, model_prio, pos, speaker, speaker_id): models in the order of
    priority, of equal speakers the first; empty labels are left out."""
    return first_wins(models.where("speaker <> ''"), ["speaker"], "model_prio", "pos").select("speaker", "model", "speaker_id")


def resolve(requests: DataFrame, aliases: DataFrame, routes: DataFrame, default_model: str) -> DataFrame:
    """Adds speaker, model and speaker_id to ``requests`` (locale): the alias of the locale or the locale itself, then its
    route, without one the default model. A null locale has no speaker."""
    spoken = requests.join(aliases.withColumnRenamed("speaker", "_alias"), "locale", "left").withColumn("speaker", F.coalesce("_alias", "locale")).drop("_alias")
    return spoken.join(routes, "speaker", "left").withColumn("model", F.coalesce("model", F.lit(default_model)))


def first_candidate(requests: DataFrame, key: list[str], candidates: Column, known: DataFrame, value: str, fallback: Column) -> DataFrame:
    """Adds ``value`` of the first of the ordered candidates that ``known`` (candidate, value) has, else the fallback."""
    tried = requests.select(*key, F.posexplode(candidates).alias("prio", "candidate")).join(known, "candidate")
    best = tried.groupBy(*key).agg(F.min_by(value, "prio").alias(value))
    return requests.join(best, key, "left").withColumn(value, F.coalesce(value, fallback))


def thresholds(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """Adds min_detected and max_main to ``pairs`` (script, main, detected): of easily confused languages that hold both,
    else of the script if it has both, else the default."""
    confused = spark.createDataFrame([(i, lang, *t) for i, (langs, t) in enumerate(CONFUSABLE) for lang in langs], "grp int, lang string, a double, b double")
    scripts = spark.createDataFrame([(s, lang, *SCRIPT_THRESHOLDS[s]) for s, langs in SCRIPT_LANGUAGES.items() for lang in langs], "script string, lang string, c double, d double")
    both = confused.alias("x").join(confused.alias("y"), F.expr("x.grp = y.grp")).select(F.col("x.lang").alias("main"), F.col("y.lang").alias("detected"), "x.a", "x.b")
    shared = scripts.alias("x").join(scripts.alias("y"), F.expr("x.script = y.script")).select("x.script", F.col("x.lang").alias("main"), F.col("y.lang").alias("detected"), "x.c", "x.d")
    joined = pairs.join(both, ["main", "detected"], "left").join(shared, ["script", "main", "detected"], "left")
    return joined.select(*pairs.columns, F.coalesce("a", "c", F.lit(DEFAULT_THRESHOLD[0])).alias("min_detected"), F.coalesce("b", "d", F.lit(DEFAULT_THRESHOLD[1])).alias("max_main"))


def sync_actions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(path, action) of two manifests (path, size): same size is skipped, what one side lacks or has in another size is sent."""
    joined = local.withColumnRenamed("size", "l").join(remote.withColumnRenamed("size", "r"), "path", "full")
    return joined.select("path", F.when(F.col("r").isNull(), "upload").when(F.col("l").isNull(), "download").when(F.col("l") == F.col("r"), "skip").otherwise("replace").alias("action"))


def count_actions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(action, n): how often each of ``sync_actions`` comes up, without its pairs, of which a path that both manifests repeat has
    as many as the product of its rows. A null path meets none, a null size counts as lacking."""
    both = local.selectExpr("path", "size", "1L as l", "0L as r").union(remote.selectExpr("path", "size", "0L as l", "1L as r"))
    sizes = both.groupBy("path", "size").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    known = F.col("size").isNotNull()
    paths = sizes.groupBy("path").agg(
        F.sum("l").alias("l"), F.sum("r").alias("r"), F.sum(F.when(known, F.col("l")).otherwise(0)).alias("ls"),
        F.sum(F.when(known, F.col("r")).otherwise(0)).alias("rs"), F.sum(F.when(known, F.col("l") * F.col("r")).otherwise(0)).alias("same"))
    n = {
        True: {"upload": "l * (r - rs)", "download": "(l - ls) * rs", "skip": "same", "replace": "ls * rs - same"},
        False: {"upload": "l + r - rs", "download": "rs", "skip": "0L", "replace": "0L"},
    }
    counts = F.array(*(F.struct(F.lit(a).alias("action"), F.expr(f"if(path is not null and l > 0 and r > 0, {n[True][a]}, {n[False][a]})").alias("n")) for a in n[True]))
    found = paths.select(F.inline(counts)).where("n > 0")
    return found.groupBy("action").agg(F.sum("n").alias("n"))


def lru_resident(accesses: DataFrame, cache: list[str], key: str, at: str, capacity: int) -> DataFrame:
    """What a least-recently-used cache of a capacity holds after all accesses: its last distinct keys, most recent first."""
    last = accesses.groupBy(*cache, key).agg(F.max(at).alias("last"))
    order = Window.partitionBy(*cache).orderBy(F.desc("last"))
    return last.withColumn("place", F.row_number().over(order)).where(F.col("place") <= capacity)
