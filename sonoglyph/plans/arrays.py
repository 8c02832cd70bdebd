"""Queries over arrays: splines and flows with their inverses, relative positions, folding, and decoding in two phases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sonoglyph.functions import flows as X
from sonoglyph.plans.registry import Registry, read
from sonoglyph.streaming import decode as S

R = Registry()

_EDGE = math.log(math.exp(1 - X.LEAST_SLOPE) - 1)
_KNOTS = "list_transform(range(0, 9), lambda i: case when i = 0 then -1.0::double when i = 8 then 1.0::double else 2 * list_sum(list_transform({0}[1:i], lambda v: 0.001 + (1 - 0.001 * 8) * v)) - 1 end)"
_SOFTMAX = "list_transform({0}, lambda v: exp(v - list_max({0})) / list_sum(list_transform({0}, lambda u: exp(u - list_max({0})))))"
_SPLINE = f"""
with e as (select vec_id, list_transform(embedding, lambda v: v::double * 4) as e from embeddings),
p as (select vec_id, e[24:64] as x, {_SOFTMAX.format('e[1:8]')} as w, {_SOFTMAX.format('e[9:16]')} as h,
  list_transform([{_EDGE}::double] || e[17:23] || [{_EDGE}::double], lambda v: 0.001 + ln(1 + exp(-abs(v))) + greatest(v, 0)) as d from e),
k as (select vec_id, unnest(x) as v, unnest(range(41)) as pos, {_KNOTS.format('w')} as kx, {_KNOTS.format('h')} as ky, d from p)"""


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, bins, pos, v): the spline that a vector's first 23 entries give, and the others as values."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 4).alias("e"))
    part = lambda a, n: F.slice("e", a, n)
    return e.select("vec_id", "e", X.spline_bins(part(1, 8), part(9, 8), part(17, 7)).alias("bins")).select("vec_id", "bins", F.posexplode(part(24, 41)).alias("pos", "v"))


@R.query(_SPLINE + """,
b as (select *, list_count(list_filter(kx[1:8], lambda q: q <= v))::int as b from k),
g as (select *, kx[b] as x0, kx[b + 1] - kx[b] as w, ky[b] as y0, ky[b + 1] - ky[b] as h, d[b] as d0, d[b + 1] as d1 from b),
t as (select *, (v - x0) / w as t, h / w as s, d0 + d1 - 2 * h / w as bend from g)
select vec_id, pos, round(case when abs(v) > 1 then v else y0 + h * (s * t * t + d0 * t * (1 - t)) / (s + bend * t * (1 - t)) end, 6) as y,
  round(case when abs(v) > 1 then 0 else ln(s * s * (d1 * t * t + 2 * s * t * (1 - t) + d0 * (1 - t) * (1 - t))) - 2 * ln(s + bend * t * (1 - t)) end, 6) as log_det from t""")
def spline_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values mapped by a rational-quadratic spline with linear tails, and the logarithm of its slope there."""
    y = X.spline(F.col("v"), F.col("bins"))
    return _bins(spark, sf_dir).select("vec_id", "pos", y.alias("y")).select("vec_id", "pos", F.round("y.value", 6).alias("y"), F.round("y.log_det", 6).alias("log_det"))


@R.query(_SPLINE + """,
b as (select *, list_count(list_filter(ky[1:8], lambda q: q <= v))::int as b from k),
g as (select *, kx[b] as x0, kx[b + 1] - kx[b] as w, v - ky[b] as up, ky[b + 1] - ky[b] as h, d[b] as d0, d[b + 1] as d1 from b),
a as (select *, h / w as s, d0 + d1 - 2 * h / w as bend from g),
q as (select *, up * bend + h * (s - d0) as a, h * d0 - up * bend as b2, -s * up as c from a)
select vec_id, pos, round(case when abs(v) > 1 then v else 2 * c / (-b2 - sqrt(greatest(b2 * b2 - 4 * a * c, 0))) * w + x0 end, 6) as x from q""")
def spline_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the spline maps to the values."""
    x = X.spline(F.col("v"), F.col("bins"), inverse=True)
    return _bins(spark, sf_dir).select("vec_id", "pos", F.round(x["value"], 6).alias("x"))


@R.query("""
with e as (select vec_id, list_transform(embedding, lambda v: v::double) as e from embeddings),
l as (select vec_id, list_reverse(list_transform(e[1:20], lambda v: ln(greatest(v, 0.00001)))) as y, e[21:40] as m, e[41:60] as s from e)
select vec_id, list_transform(range(1, 21), lambda i: round(m[i] + exp(s[i]) * y[i], 6)) as y, round(list_sum(s) - list_sum(y), 5) as log_det from l""")
def flow_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithm, reversal of channels and an affine map one after another, with the logarithm of the whole map's determinant."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    logs = e.select("vec_id", "e", X.flip(X.log_flow(F.slice("e", 1, 20))).alias("l"))
    s = F.slice("e", 41, 20)
    return logs.select("vec_id", F.transform(X.affine(F.col("l"), F.slice("e", 21, 20), s), lambda v: F.round(v, 6)).alias("y"), F.round(X.total(s) - X.total(F.col("l")), 5).alias("log_det"))


_LINES = "select l_orderkey, l_linenumber as i, l_quantity::double as q, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) - 1 as p, count(*) over (partition by l_orderkey) as n from lineitem"


def _matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, x): a square matrix for each order, entry i, j made of its lines i and j."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q")))).alias("x"))
    return lines.select("l_orderkey", F.transform("x", lambda a: F.transform("x", lambda b: a["q"] * 100 + b["q"])).alias("x"))


@R.query(f"""
with l as ({_LINES}), r as (select a.l_orderkey, a.p as i, a.n, a.q as a, unnest(range(2 * a.n - 1)) as k from l a)
select r.l_orderkey, r.i::int as i, r.k::int as k, coalesce(r.a * 100 + b.q, 0.0) as v from r left join l b on b.l_orderkey = r.l_orderkey and b.p = r.k + r.i - r.n + 1""")
def relative_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's matrix by relative position, zero where there is no such place."""
    rows = _matrices(spark, sf_dir).select("l_orderkey", F.posexplode(X.relative_positions(F.col("x"))).alias("i", "r"))
    return rows.select("l_orderkey", "i", F.posexplode("r").alias("k", "v"))


@R.query(f"""with l as ({_LINES}) select a.l_orderkey, a.p::int as i, b.p::int as j, a.q * 100 + (b.p - a.p + a.n - 1) as v from l a join l b using (l_orderkey)""")
def absolute_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by relative position, here the position itself on top of the line's, by place."""
    x = _matrices(spark, sf_dir)
    n = F.size("x")
    relative = F.transform("x", lambda r: F.transform(F.sequence(F.lit(0), 2 * n - 2), lambda k: F.floor(r[0] / 100) * 100 + k + F.lit(0.0)))
    rows = x.select("l_orderkey", F.posexplode(X.absolute_positions(relative)).alias("i", "r"))
    return rows.select("l_orderkey", "i", F.posexplode("r").alias("j", "v"))


@R.query("""
with l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_discount) - 1 as p, [l_quantity::double, l_discount::double * 100] as q from lineitem),
s as (select a.l_orderkey, a.p as i, b.p as j, case when abs(b.p - a.p) <= 4 then a.q[1] * (b.p - a.p + 4) + a.q[2] * (0.5 - (b.p - a.p)) else 0 end as v from l a join l b using (l_orderkey))
select l_orderkey, i::int as i, j::int as j, round(v, 6) as v from s""")
def banded_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each order's lines with keys of relative positions, four to each side."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100).alias("q")))).alias("x"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.array(k.cast("double"), 4.5 - k.cast("double")))
    rows = lines.select("l_orderkey", F.posexplode(X.banded_scores(F.transform("x", lambda a: a["q"]), keys, 4)).alias("i", "r"))
    return rows.select("l_orderkey", "i", F.posexplode("r").alias("j", "v")).withColumn("v", F.round("v", 6))


_PERIODS = [2, 3, 5, 7, 11]


@R.query(f"""
with e as (select vec_id, list_transform(embedding, lambda v: v::double) as e, unnest({_PERIODS}) as period from embeddings),
f as (select vec_id, period, e || list_reverse(e[len(e) - (period - len(e) % period) % period : len(e) - 1]) as f, e from e)
select vec_id, period::int as period, (unnest(range(len(f) // period)))::int as r, f[unnest(range(len(f) // period)) * period + 1 : unnest(range(len(f) // period)) * period + period] as row from
  (select vec_id, period, case when len(e) % period = 0 then e else f end as f from f)""")
def folded_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as rows of several periods, filled up by reflection."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"), F.explode(F.array(*map(F.lit, _PERIODS))).alias("period"))
    return e.select("vec_id", "period", F.posexplode(X.folded(F.col("e"), F.col("period"))).alias("r", "row"))


@R.query("""
with e as (select vec_id, list_transform(embedding, lambda v: v::double) as e from embeddings)
select vec_id, [0.0::double, 0, 0, 0] || e as causal, [0.0::double] || e || [0.0::double, 0] as same from e""")
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeros for a causal convolution of width 5, and for one of width 4 in the middle."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", X.padded(e, 5, True).alias("causal"), X.padded(e, 4, False).alias("same"))


def _samples(codes: Column) -> Column:
    """Three samples of each frame but the last, which has one: a decoder that needs what comes next."""
    of_frame = lambda c, i: F.when(i < F.size(codes) - 1, F.array(c, c + 0.25, c + 0.5)).otherwise(F.array(c))
    return F.flatten(F.transform(codes, of_frame))


@R.query("""
with f as (select user_id, event_id, round(value, 2)::double as code, row_number() over (partition by user_id order by event_id) - 1 as pos, count(*) over (partition by user_id) as n from events),
c as (select user_id, pos // 12 as chunk, max(pos) + 1 as total, count(*) as n_new from f group by all),
p as (select *, case when chunk * 12 >= 25 then 2 else 1 end as phase, case when chunk * 12 >= 25 then least(25, chunk * 12) else 0 end as n_context from c),
s as (select *, case when phase = 1 then 0 else total - n_new - n_context end as first, (3 * 36 - 2) / 36.0::double as per_frame,
        case when phase = 1 then greatest(3 * (total - n_new) - 2, 0) else round_even(n_context * ((3 * 36 - 2) / 36.0::double), 0)::bigint end as cut, 3 * (case when phase = 1 then total else n_context + n_new end) - 2 as made from p),
a as (select s.user_id, s.chunk, s.phase, s.n_context, s.n_new, s.cut, s.made, s.total, s.first, k.k, 3 * (f.pos - s.first) + k.k as place, f.code + k.k * 0.25 as v from s join f on f.user_id = s.user_id and f.pos >= s.first and f.pos < s.total
        cross join (values (0), (1), (2)) k(k) where k.k = 0 or f.pos < s.total - 1)
select user_id, chunk, phase, n_context::int as n_context, n_new::int as n_new, greatest(any_value(made) - any_value(cut), 0)::int as n_samples, round(coalesce(sum(v) filter (where place >= cut), 0), 3) as total_audio from a group by user_id, chunk, phase, n_context, n_new""")
def streamed_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as frames, decoded in chunks: all of them until 25 are there, then the new ones with their context."""
    frames = read(spark, sf_dir, "events").select("user_id", "event_id", F.round("value", 2).cast("double").alias("code"))
    out = S.decode_chunks(frames, "user_id", "event_id", 12, _samples)
    return out.select("user_id", "chunk", "phase", "n_context", "n_new", F.size("audio").alias("n_samples"), F.round(X.total(F.col("audio")), 3).alias("total_audio"))


QUERIES, ORACLE_SQL = R.queries, R.sql
