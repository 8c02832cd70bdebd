"""Queries over ordered events: chunks, contexts, queues, running metrics, markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sonoglyph.plans.registry import Registry, read
from sonoglyph.streaming import chunks as C

R = Registry()


@R.query("""
with s as (select user_id, value, (row_number() over (partition by user_id order by event_id) - 1) // 12 as chunk from events)
select user_id, chunk, count(*) as n_steps, chunk * 12 + count(*) as total, count(*) < 12 as is_final, round(sum(value), 4) as value from s group by user_id, chunk""")
def chunk_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks(read(spark, sf_dir, "events"), "user_id", "event_id", 12).withColumn("value", F.round("value", 4))


@R.query("""
select event_id, user_id, count(*) over w as ctx, round(coalesce(sum(value) over w, 0), 4) as ctx_value from events
window w as (partition by user_id order by event_id rows between 25 preceding and 1 preceding)""")
def sliding_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sliding_context(read(spark, sf_dir, "events"), "user_id", "event_id", 25).select("event_id", "user_id", "ctx", F.round("ctx_value", 4).alias("ctx_value"))


@R.query("""
with c as (select user_id, (row_number() over (partition by user_id order by event_id) - 1) // 12 as chunk, value from events),
m as (select user_id, chunk, sum(value) as ms, count(*) / 12.0::double as audio_s from c group by all)
select user_id, chunk, round(sum(ms) over w, 4) as total_ms, round(sum(audio_s) over w, 6) as total_audio_s, round(case when sum(ms) over w > 0 then sum(audio_s) over w / (sum(ms) over w / 1000) else 0 end, 6) as rtf,
  round(first_value(ms) over (partition by user_id order by chunk), 4) as ttfa_ms from m window w as (partition by user_id order by chunk rows unbounded preceding)""")
def chunk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running generation time and audio of each user's chunks, real-time factor (audio over generation) and time to the first chunk."""
    rows = read(spark, sf_dir, "events").withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) / 12))
    sums = rows.groupBy("user_id", "chunk").agg(F.sum("value").alias("ms"), (F.count(F.lit(1)) / 12.0).alias("audio_s"))
    w = Window.partitionBy("user_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    ms, audio = F.sum("ms").over(w), F.sum("audio_s").over(w)
    return sums.select("user_id", "chunk", F.round(ms, 4).alias("total_ms"), F.round(audio, 6).alias("total_audio_s"), F.round(F.when(ms > 0, audio / (ms / 1000)).otherwise(0.0), 6).alias("rtf"), F.round(F.first("ms").over(w), 4).alias("ttfa_ms"))


@R.query("""
with recursive q as (select user_id, event_id, floor(epoch(ts))::bigint as arrival, (1 + event_id % 5) * 2000 as work, row_number() over (partition by user_id order by floor(epoch(ts))::bigint, event_id) as n from events),
s as (select user_id, event_id, n, arrival, work, arrival + work as finish from q where n = 1
      union all select q.user_id, q.event_id, q.n, q.arrival, q.work, greatest(s.finish, q.arrival) + q.work from s join q on q.user_id = s.user_id and q.n = s.n + 1)
select event_id, user_id, finish - work as begin, finish from s""")
def queue_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("request"), F.unix_timestamp("ts").alias("arrival"), ((1 + F.col("event_id") % 5) * 2000).alias("work"))
    return C.queue(asked, "user_id").select(F.col("request").alias("event_id"), "user_id", "begin", "finish")


@R.query("""
with w as (select o_custkey, o_orderkey, o_totalprice, case when o_orderpriority < '3' then 'WORD' else 'PHONEME' end as type from orders),
g as (select *, sum(case when type = 'WORD' then 1 else 0 end) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as g from w)
select o_custkey, g::bigint as word, min(o_orderkey) as first_key, count(*) - 1 as n_phonemes from g where g > 0 group by o_custkey, g""")
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word event opens a span that holds the phoneme events up to the next one; those before the first word are in none."""
    rows = read(spark, sf_dir, "orders").withColumn("word", F.sum(F.when(F.col("o_orderpriority") < "3", 1).otherwise(0)).over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("word > 0").groupBy("o_custkey", "word").agg(F.min("o_orderkey").alias("first_key"), (F.count(F.lit(1)) - 1).alias("n_phonemes"))


@R.query("""
with p as (select user_id, props, event_id from events)
select event_id, json_extract_string(props, '$.' || (json_keys(props)[1])) as first_value from p""")
def json_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first property of each event's JSON."""
    m = F.from_json("props", "map<string,string>")
    return read(spark, sf_dir, "events").select("event_id", F.get(F.map_values(m), 0).alias("first_value"))


QUERIES, ORACLE_SQL = R.queries, R.sql
