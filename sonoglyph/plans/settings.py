"""Queries over settings, configurations and checks of requests, and small kernels of the acoustic model's data path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sonoglyph.functions import audio as A, text as X
from sonoglyph.operators.sampling import let
from sonoglyph.operators.runtime import asked_mode
from sonoglyph.plans.registry import Registry, read, sql_rows
from sonoglyph.sources.shared import scratch

R = Registry()
_FIELDS = ["dtype", "audio_dtype", "attn", "layers", "predictor_layers", "decoder", "blocks", "extra"]
# Settings of each precision mode, and the names that it goes by.
_MODES = [
    ("optimized", "auto", "auto", "auto", "auto", "none", "none", "none", "none"),
    ("balanced", "auto", "auto", "auto", "auto", "0,1,3,4", "none", "none", "none"),
    ("aggressive", "auto", "auto", "auto", "auto", "0,1,3,4", "fp16", "fp16", "fp16_inner"),
    ("bf16", "bfloat16", "same", "sdpa", "none", "none", "none", "none", "none"),
]
_MODE_NAMES = {
    "optimized": "optimized", "auto": "optimized", "fp16": "optimized", "mixed": "optimized", "stable": "optimized", "balanced": "balanced",
    "aggressive": "aggressive", "max": "aggressive", "maximum": "aggressive", "bf16": "bf16", "bfloat16": "bf16", "off": "bf16", "disabled": "bf16", "original": "bf16",
}
_RAW = "case c_custkey % 7 when 0 then ' MAX ' when 1 then 'off' when 2 then 'warp' when 3 then 'mixed' when 4 then 'balanced' when 5 then case when c_custkey % 2 = 0 then '' else '   ' end end"
_OPTIMIZED = "case c_custkey % 3 when 0 then 'yes' when 1 then 'no' end"
_DTYPE = "case c_custkey % 5 when 0 then ' float32 ' when 1 then '  ' end"


@R.query(f"""
with m({', '.join(['mode', *_FIELDS])}) as (values {sql_rows(_MODES)}), n(name, mode) as (values {sql_rows(list(_MODE_NAMES.items()))}),
q as (select c_custkey, case when coalesce({_RAW}, '') <> '' then nullif(lower(trim({_RAW})), '') else case when {_OPTIMIZED} in ('1', 'true', 'yes', 'on') then 'optimized' when {_OPTIMIZED} is not null then 'bf16' end end as asked, nullif(trim({_DTYPE}), '') as d from customer)
select c_custkey, case when n.mode is null and asked is not null then null when d is not null then 'custom' else coalesce(n.mode, 'optimized') end as mode, case when n.mode is null and asked is not null then null else coalesce(d, m.dtype) end as dtype,
  case when n.mode is null and asked is not null then null else m.predictor_layers || '/' || m.extra end as others, case when n.mode is null and asked is not null then 'unknown mode ' || asked end as error
from q left join n on n.name = q.asked left join m on m.mode = coalesce(n.mode, 'optimized')""")
def precision_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings by the mode that is asked for, under any of its names, or by an older switch; a setting of its own makes the
    mode ``custom``, an unknown mode is an error."""
    asked = asked_mode(F.expr(_RAW), F.expr(_OPTIMIZED))
    names = F.create_map(*(F.lit(x) for kv in _MODE_NAMES.items() for x in kv))
    modes = F.create_map(*(x for m in _MODES for x in (F.lit(m[0]), F.struct(*(F.lit(v).alias(f) for f, v in zip(_FIELDS, m[1:], strict=True))))))
    rows = read(spark, sf_dir, "customer").select("c_custkey", asked.alias("asked"), F.nullif(F.trim(F.expr(_DTYPE)), F.lit("")).alias("d"))
    rows = rows.withColumn("mode", F.element_at(names, F.col("asked"))).withColumn("bad", F.col("mode").isNull() & F.col("asked").isNotNull())
    rows = rows.withColumn("mode", F.coalesce("mode", F.lit("optimized"))).withColumn("m", F.element_at(modes, F.col("mode")))
    good = lambda c: F.when(~F.col("bad"), c)
    return rows.select(
        "c_custkey", good(F.when(F.col("d").isNotNull(), "custom").otherwise(F.col("mode"))).alias("mode"), good(F.coalesce("d", "m.dtype")).alias("dtype"),
        good(F.concat("m.predictor_layers", F.lit("/"), "m.extra")).alias("others"), F.when(F.col("bad"), F.concat(F.lit("unknown mode "), "asked")).alias("error"))


@R.query("""
select s_suppkey, case when s_suppkey % 2 = 0 then 'm' || s_suppkey else 'default' end as default_model, case when s_suppkey % 3 = 0 then s_suppkey % 9 else 1 end as max_models, case when s_suppkey % 4 = 0 then ['a', 'b'] else [] end as models from supplier""")
def server_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations as JSON objects over several lines, each missing field with its default."""
    path = scratch(spark, "configs")
    fields = F.struct("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("m"), "s_suppkey")).alias("default_model"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 9).alias("max_models"), F.when(F.col("s_suppkey") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).alias("models"))
    listed = F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.to_json(fields)), ",\n"), F.lit("\n]\n"))
    read(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 16).alias("file")).agg(listed.alias("value")).select("value").repartition(4).write.option("maxRecordsPerFile", 1).text(path)  # a file each
    got = spark.read.schema("s_suppkey long, default_model string, max_models long, models array<string>").json(path, multiLine=True)
    return got.select("s_suppkey", F.coalesce("default_model", F.lit("default")).alias("default_model"), F.coalesce("max_models", F.lit(1)).alias("max_models"), F.coalesce("models", F.expr("array()").cast("array<string>")).alias("models"))


@R.query("select n_name as model, 'spk' || i as speaker, (n_nationkey * 10 + i)::int as speaker_id from nation, (select unnest(range(3)) as i) where n_nationkey % 4 <> 0")
def speaker_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of models, from their configurations alone; a model without a map has none."""
    ids = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.concat(F.lit("spk"), i), F.col("n_nationkey") * 10 + i)))
    configs = read(spark, sf_dir, "nation").select("n_name", F.to_json(F.struct(F.when(F.col("n_nationkey") % 4 != 0, ids).alias("speaker_id_map"), F.lit("x").alias("other"))).alias("c"))
    parsed = configs.select("n_name", F.from_json("c", "speaker_id_map map<string,int>").alias("c"))
    return parsed.select(F.col("n_name").alias("model"), F.explode("c.speaker_id_map").alias("speaker", "speaker_id"))


@R.query("""
with p as (select distinct event_type as preset, length(event_type) as label from events), q as (select c_custkey, case c_custkey % 4 when 0 then 'purchase' when 1 then 'click' when 2 then 'nothing' else 'view' end as preset from customer)
select c_custkey, label, case when p.preset is null then 'preset not found' end as error from q left join p using (preset)""")
def preset_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    presets = read(spark, sf_dir, "events").select(F.col("event_type").alias("preset")).distinct().withColumn("label", F.length("preset").cast("long"))
    asked = read(spark, sf_dir, "customer").selectExpr("c_custkey", "case c_custkey % 4 when 0 then 'purchase' when 1 then 'click' when 2 then 'nothing' else 'view' end as preset")
    return asked.join(presets, "preset", "left").select("c_custkey", "label", F.when(F.col("label").isNull(), "preset not found").alias("error"))


@R.query("""
with a as (select n_nationkey as g, n_name as model from nation), c as (select s_nationkey as g, 'm' || (s_suppkey % 5) as model from supplier where s_nationkey % 2 = 0),
x as (select g, model from c union select a.g, a.model from a where a.g not in (select g from c))
select g, count(*) as n_allowed, min(model) as first from x group by g""")
def allowed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured models of each group, or the available ones of groups that configure none."""
    available = read(spark, sf_dir, "nation").selectExpr("n_nationkey as g", "n_name as model")
    configured = read(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").selectExpr("s_nationkey as g", "'m' || (s_suppkey % 5) as model").distinct()
    both = configured.union(available.join(configured.select("g").distinct(), "g", "left_anti"))
    return both.groupBy("g").agg(F.count(F.lit(1)).alias("n_allowed"), F.min("model").alias("first"))


_PROMPTS = ["event_id", "user_id % 3 + 1 as wanted", "event_id % 4 + 0 as n", "event_id % 2 = 0 as xvec", "event_id % 5 <> 0 as icl", "event_id % 3 = 0 as has_code", "case when event_id % 7 = 0 then '' else 'ref' end as ref_text"]


@R.query(f"""
with p as (select {', '.join(_PROMPTS)} from events)
select event_id, case when n <> wanted then 'length ' || n || ' of ' || wanted when xvec = icl then 'modes must be opposites' when xvec and has_code then 'code in vector mode' when icl and not has_code then 'no code in context mode' when icl and ref_text = '' then 'no reference text' end as error from p""")
def prompt_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why voice prompts are refused: their number, modes that are not opposites, codes that a mode must or must not have, a missing text."""
    p = read(spark, sf_dir, "events").selectExpr(*_PROMPTS)
    error = (
        F.when(F.col("n") != F.col("wanted"), F.concat(F.lit("length "), "n", F.lit(" of "), "wanted")).when(F.col("xvec") == F.col("icl"), "modes must be opposites")
        .when(F.col("xvec") & F.col("has_code"), "code in vector mode").when(F.col("icl") & ~F.col("has_code"), "no code in context mode").when(F.col("icl") & (F.col("ref_text") == ""), "no reference text"))
    return p.select("event_id", error.alias("error"))


@R.query("""
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), m as (select *, list_avg(v) as m from v), s as (select *, list_avg(list_transform(v, lambda x: (x - m) * (x - m))) as var from m)
select vec_id, list_transform(v, lambda x: round((x - m) / sqrt(var + 1e-5) * 1.1 + 0.1, 6)) as normed from s""")
def layer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector less its mean over its deviation, scaled and shifted."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    centred = vectors.select("vec_id", let(mean(F.col("v")), lambda m: F.transform("v", lambda x: x - m)).alias("v"))
    normed = let(F.sqrt(mean(F.transform("v", lambda x: x * x)) + 1e-5), lambda s: F.transform(F.transform("v", lambda x: x / s * 1.1 + 0.1), lambda x: A.rounded(x, 6)))
    return centred.select("vec_id", normed.alias("normed"))


@R.query("select vec_id, list_transform(embedding, lambda x: round(ln(greatest(abs(x::double), 1e-5)), 6)) as squeezed, round(list_sum(list_transform(embedding, lambda x: exp(ln(greatest(abs(x::double), 1e-5))))), 5) as back from embeddings")
def log_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes as logarithms with a floor, and back."""
    squeezed = F.transform("embedding", lambda x: F.ln(F.greatest(F.abs(x.cast("double")), F.lit(1e-5))))
    back = F.aggregate(F.transform("s", F.exp), F.lit(0.0), lambda a, x: a + x)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", squeezed.alias("s"))
    return rows.select("vec_id", F.transform("s", lambda x: F.round(x, 6)).alias("squeezed"), F.round(back, 5).alias("back"))


@R.query("select event_id, list_filter(range(12), lambda i: list_contains(string_split('1,4,' || (event_id % 12), ','), i::varchar)) as layers from events")
def layer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices that a list names."""
    spec = F.split(F.concat(F.lit("1,4,"), F.col("event_id") % 12), ",")
    layers = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long")), lambda i: F.array_contains(spec, i.cast("string")))
    return read(spark, sf_dir, "events").select("event_id", layers.alias("layers"))


@R.query("""
with n as (select n_name, n_regionkey, row_number() over (partition by n_regionkey order by n_name) as place from nation) select n_regionkey, place, n_name from n""")
def ordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each group with their place in its order."""
    w = Window.partitionBy("n_regionkey").orderBy("n_name")
    return read(spark, sf_dir, "nation").select("n_regionkey", F.row_number().over(w).cast("long").alias("place"), "n_name")


QUERIES, ORACLE_SQL = R.queries, R.sql
