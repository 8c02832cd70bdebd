"""Queries over logits, samples and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sonoglyph.functions import audio as A
from sonoglyph.operators import sampling as S
from sonoglyph.plans.registry import Registry, read

R = Registry()
_L = "l as (select vec_id, unnest(range(64)) as token, unnest(embedding)::double * 10 as logit from embeddings)"
_P = "e as (select *, exp(logit - max(logit) over (partition by vec_id)) as e from l), p as (select vec_id, token, logit, e / sum(e) over (partition by vec_id) as p from e)"


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"))


def _tokens(rows: DataFrame, pairs: Column) -> DataFrame:
    return rows.select("vec_id", F.explode(pairs).alias("s")).select("vec_id", "s.token", F.round("s.logit", 6).alias("logit"))


@R.query(f"with {_L} select vec_id, token, round(logit, 6) as logit from (select *, rank() over (partition by vec_id order by logit desc) as r from l) where r <= 5")
def topk_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(_logits(spark, sf_dir), S.top_k(F.col("logits"), 5))


@R.query(f"with {_L}, {_P} select vec_id, token, round(logit, 6) as logit, round(p, 6) as p from p")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.arrays_zip(S.numbered(F.col("logits")).alias("s"), S.softmax(F.col("logits")).alias("p"))
    rows = _logits(spark, sf_dir).select("vec_id", F.explode(both).alias("z"))
    return rows.select("vec_id", F.col("z.s.token").alias("token"), F.round("z.s.logit", 6).alias("logit"), F.round("z.p", 6).alias("p"))


@R.query(f"""
with {_L}, {_P}, c as (select *, sum(p) over (partition by vec_id order by logit desc, token rows unbounded preceding) as s, row_number() over (partition by vec_id order by logit desc, token) as n from p)
select vec_id, count(*) as n_kept, round(sum(p), 6) as mass from c where s <= 0.8 or n = 1 group by vec_id""")
def topp_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _logits(spark, sf_dir).select("vec_id", S.top_p(F.col("logits"), 0.8).alias("k"))
    return kept.select("vec_id", F.size("k").cast("long").alias("n_kept"), F.round(F.aggregate("k", F.lit(0.0), lambda a, s: a + s["p"]), 6).alias("mass"))


@R.query(f"""
with {_L}, h as (select distinct vec_id, (vec_id * 7 + k * k) % 64 as token from embeddings, (select unnest(range(6)) as k))
select vec_id, token, round(case when h.token is null then logit when logit > 0 then logit / 1.05 else logit * 1.05 end, 6) as logit from l left join h using (vec_id, token)""")
def repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: ((F.col("vec_id") * 7 + k * k) % 64).cast("int"))
    put = _logits(spark, sf_dir).select("vec_id", S.repetition_penalty(F.col("logits"), history, 1.05).alias("logits"))
    return _tokens(put, S.numbered(F.col("logits")))


@R.query(f"with {_L} select vec_id, (min_by(token, token) filter (where logit = m))::int as token from (select *, max(logit) over (partition by vec_id) as m from l) group by vec_id")
def greedy_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).select("vec_id", S.greedy(F.col("logits")).alias("token"))


@R.query(f"""
with {_L}, {_P}, c as (select *, sum(p) over (partition by vec_id order by token rows unbounded preceding) as s from p)
select vec_id, least(count(*) filter (where s <= (vec_id * 37 % 100) / 100.0::double), 63)::int as token from c group by vec_id""")
def sampled_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token drawn by its probability, the draws being given."""
    return _logits(spark, sf_dir).select("vec_id", S.sampled(F.col("logits"), (F.col("vec_id") * 37 % 100) / 100.0).alias("token"))


@R.query(f"""
with {_L}, s as (select *, token >= 48 and token <> 50 or token = 50 and vec_id % 7 < 3 as gone from l)
select vec_id, count(*) filter (where gone) as n_suppressed, round(max(case when not gone then logit end), 6) as best from s group by vec_id""")
def suppress_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ids suppressed but for the end id, and that too before the third step."""
    held = S.suppress_end(S.suppress(F.col("logits"), 16, 50), 50, F.col("vec_id") % 7, 3)
    rows = _logits(spark, sf_dir).select("vec_id", held.alias("h"))
    return rows.select("vec_id", F.size(F.filter("h", lambda x: x == float("-inf"))).cast("long").alias("n_suppressed"), F.round(F.array_max("h"), 6).alias("best"))


@R.query("""
with s as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as step, case when event_type = (select min(event_type) from events) then 2 else 5 end as token from events)
select user_id, coalesce(min(step) filter (where token = 2), count(*)) as n_steps from s group by user_id""")
def stop_at_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    events = read(spark, sf_dir, "events")
    first = events.agg(F.min("event_type").alias("end"))
    steps = events.join(F.broadcast(first)).select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("step"), F.when(F.col("event_type") == F.col("end"), 2).otherwise(5).alias("token"))
    return S.until_end(steps, ["user_id"], 2)


def _waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("w"))


_W = "w as (select vec_id, list_transform(embedding, lambda x: x::double) as w from embeddings)"


@R.query(f"""
with {_W}, p as (select vec_id, w, greatest(list_max(list_transform(w, lambda x: abs(x))), 0.01) as peak from w)
select vec_id, round(peak, 6) as peak, list_transform(w, lambda x: trunc(greatest(-32767.0::double, least(32767.0::double, x * (32767.0::double / peak))))::smallint) as samples from p""")
def float_to_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waves(spark, sf_dir).select("vec_id", F.round(A.peak(F.col("w")), 6).alias("peak"), A.to_int16(F.col("w")).alias("samples"))


_FRAMES = "f as (select vec_id, w, list_transform(range(0, len(w) + greatest(0, 16 - len(w) % 8) - 15, 8), lambda s: sqrt(coalesce(list_sum(list_transform(list_slice(w, s + 1, s + 16), lambda x: x * x)), 0) / 16)) as rms from w)"


@R.query(f"with {_W}, {_FRAMES} select vec_id, list_transform(rms, lambda x: round(x, 6)) as rms from f")
def frame_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waves(spark, sf_dir).select("vec_id", F.transform(A.frame_rms(F.col("w"), 16, 8), lambda x: F.round(x, 6)).alias("rms"))


@R.query(f"""
with w as (select vec_id, list_transform(embedding, lambda x, i: case when i <= 20 or i > 50 then x::double / 1000 else x::double end) as w from embeddings), {_FRAMES},
t as (select vec_id, len(w) as n, rms, greatest(pow(10, -45.0 / 20), list_max(rms) * pow(10, -35.0 / 20)) as thr from f),
v as (select vec_id, n, list_filter(list_transform(rms, lambda r, i: case when r > thr then i - 1 end), lambda i: i is not null) as v from t)
select vec_id, (case when len(v) = 0 then 0 else greatest(0, v[1] * 8 - 2) end)::int as start, (case when len(v) = 0 then n else least(n, v[-1] * 8 + 16 + 2) end)::int as stop from v""")
def trim_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet = _waves(spark, sf_dir).select("vec_id", F.transform("w", lambda x, i: F.when((i < 20) | (i >= 50), x / 1000).otherwise(x)).alias("w"))
    framed = quiet.select("vec_id", F.size("w").alias("n"), A.frame_rms(F.col("w"), 16, 8).alias("rms"))
    return framed.select("vec_id", A.voiced_bounds(F.col("rms"), F.col("n"), 16, 8, 2).alias("b")).select("vec_id", "b.start", "b.stop")


@R.query("""
with d as (select l_orderkey, list((l_quantity % 5)::int order by l_linenumber, l_quantity % 5) as d from lineitem group by l_orderkey)
select l_orderkey, flatten(list_transform(d, lambda x, i: list_transform(range(x), lambda k: (i - 1)::int))) as path from d""")
def duration_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") % 5).cast("int").alias("d")))).alias("s"))
    return lines.select("l_orderkey", A.duration_path(F.transform("s", lambda x: x["d"])).alias("path"))


@R.query("select event_id, trunc(trunc(value) * 24000 / 1000)::bigint as n_samples from events")
def silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", A.silence_samples(F.col("value").cast("long"), 24_000).alias("n_samples"))


@R.query(f"""
with {_W}, a as (select label, unnest(range(64)) as i, unnest(list_transform(embedding, lambda x: x::double)) as x from embeddings where vec_id % 3 <> 0), m as (select label, i, avg(x) as x from a group by all), n as (select *, greatest(sqrt(sum(x * x) over (partition by label)), 1e-12) as norm from m)
select label, list(round(x / norm, 6) order by i) as pooled from n group by label""")
def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label's rows that are not masked, of length 1."""
    rows = read(spark, sf_dir, "embeddings").where("vec_id % 3 <> 0").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"), F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(1e-12)).alias("norm"))
    return vectors.select("label", F.transform("s", lambda v: F.round(v["x"] / F.col("norm"), 6)).alias("pooled"))


@R.query(f"with {_W} select a.vec_id, round(list_cosine_similarity(a.w, b.w) / greatest(abs(0.07), 0.01), 6) as score from w a join w b on b.vec_id = a.vec_id + 1")
def cosine_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    waves = _waves(spark, sf_dir)
    after = waves.select((F.col("vec_id") - 1).alias("vec_id"), F.col("w").alias("v"))
    return waves.join(after, "vec_id").select("vec_id", F.round(A.cosine(F.col("w"), F.col("v")) / max(abs(0.07), 0.01), 6).alias("score"))


@R.query("select event_id, len(list_filter([0.0, 10.0, 25.0, 50.0, 100.000001], lambda b: value >= b)) - 1 as bin from events")
def search_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = F.array(*(F.lit(x) for x in (0.0, 10.0, 25.0, 50.0, 100.000001)))
    return read(spark, sf_dir, "events").select("event_id", A.bin_of(F.col("value"), edges).cast("long").alias("bin"))


@R.query("""
select vec_id, round(list_sum(list_transform(range(1, 33), lambda i: (embedding[i + 32]::double - embedding[i]::double) - 0.5 + 0.5 * (exp(2 * embedding[i]::double) + embedding[i]::double * embedding[i]::double) * exp(-2 * embedding[i + 32]::double))), 6) as kl from embeddings""")
def kl_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first half as mean and log deviation against the second half as log deviation."""
    p, q = F.slice("w", 1, 32), F.slice("w", 33, 32)
    terms = F.zip_with(p, q, lambda a, b: (b - a) - 0.5 + 0.5 * (F.exp(2 * a) + a * a) * F.exp(-2 * b))
    return _waves(spark, sf_dir).select("vec_id", F.round(A.total(terms), 6).alias("kl"))


@R.query("""select vec_id, list_transform(range(1, 33), lambda i: round(tanh(embedding[i]::double) / (1 + exp(-embedding[i + 32]::double)), 6)) as gated from embeddings""")
def tanh_sigmoid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = F.zip_with(F.slice("w", 1, 32), F.slice("w", 33, 32), lambda a, b: F.tanh(a) / (1 + F.exp(-b)))
    return _waves(spark, sf_dir).select("vec_id", F.transform(gated, lambda x: A.rounded(x, 6)).alias("gated"))


@R.query("""
with d as (select conv_id, list(length(text) order by turn) as n from conversations group by conv_id), m as (select conv_id, n, len(n) as k, max(len(n)) over () as most from d)
select conv_id, list_transform(range(most), lambda i: 0::bigint)[1:most - k] || n as padded, list_transform(range(most), lambda i: i >= most - k) as mask from m""")
def left_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences padded on the left to the longest one's length, with the mask of what is not padding."""
    seqs = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("s"))
    seqs = seqs.select("conv_id", F.transform("s", lambda x: x["n"]).alias("n"))
    most = F.broadcast(seqs.agg(F.max(F.size("n")).alias("most")))
    pads = F.col("most") - F.size("n")
    joined = seqs.join(most)
    return joined.select("conv_id", F.concat(F.array_repeat(F.lit(0).cast("long"), pads), "n").alias("padded"), F.transform(F.sequence(F.lit(0), F.col("most") - 1), lambda i: i >= pads).alias("mask"))


QUERIES, ORACLE_SQL = R.queries, R.sql
