"""Queries over positions, ranges, profiles and small kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sonoglyph.operators.mapping import map_words
from sonoglyph.plans.registry import Registry, read

R = Registry()


@R.query("""
with w as (select l_orderkey, l_linenumber as pos, l_partkey % 1000 as ms, (l_partkey % 1000) + 1 + l_suppkey % 40 as me from lineitem),
h as (select l_orderkey, (l_partkey % 1000) + 5 as hs, (l_partkey % 1000) + 15 as he from lineitem),
m as (select l_orderkey, hs, he, min(ms * 10 + pos) as first from h join w using (l_orderkey) where (ms <= hs and hs < me) or (ms < he and he <= me) group by all)
select l_orderkey, hs, count(*) as n, min(first) as first from m group by all""")
def overlap_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that start or end inside a word's span, joined by range within each order."""
    lines = read(spark, sf_dir, "lineitem")
    words = lines.selectExpr("l_orderkey", "l_linenumber as pos", "l_partkey % 1000 as ms", "(l_partkey % 1000) + 1 + l_suppkey % 40 as me")
    spans = lines.selectExpr("l_orderkey", "(l_partkey % 1000) + 5 as hs", "(l_partkey % 1000) + 15 as he")
    met = spans.join(words, "l_orderkey").where("(ms <= hs and hs < me) or (ms < he and he <= me)")
    return met.groupBy("l_orderkey", "hs", "he").agg(F.min(F.expr("ms * 10 + pos")).alias("first")).groupBy("l_orderkey", "hs").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))


@R.query("""
with t as (select conv_id, turn, string_split(role, '') as a, string_split(text, ' ') as b from conversations),
z as (select conv_id, turn, list_zip(a[1:least(len(a), len(b))], b[1:least(len(a), len(b))]) as z from t)
select conv_id, turn, len(z) as n, array_to_string(list_transform(z, lambda x: x[1] || '=' || x[2]), ',') as pairs from z""")
def word_phoneme_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sequences joined by position, as long as the shorter one."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("role", "").alias("a"), F.split("text", " ").alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    pairs = F.zip_with(F.slice("a", 1, n), F.slice("b", 1, n), lambda x, y: F.concat(x, F.lit("="), y))
    return rows.select("conv_id", "turn", n.cast("long").alias("n"), F.array_join(pairs, ",").alias("pairs"))


@R.query(r"""
with s as (select conv_id, turn, text, unnest(string_split(text, '. ')) as s, unnest(range(len(string_split(text, '. ')))) as sentence from conversations),
o as (select *, coalesce(sum(length(s)) over (partition by conv_id, turn order by sentence rows between unbounded preceding and 1 preceding), 0)::int as shift from s),
c as (select conv_id, turn, sentence, shift, unnest(range(length(s))) as p, unnest(string_split(s, '')) as ch from o where length(s) > 0),
r as (select *, sum(case when ch = ' ' then 1 else 0 end) over (partition by conv_id, turn, sentence order by p) as g from c),
g as (select conv_id, turn, sentence, shift, g, min(p)::int as "start", (max(p) + 1)::int as "end" from r where ch <> ' ' group by all),
gn as (select *, row_number() over (partition by conv_id, turn order by sentence, g) as n from g),
w as (select conv_id, turn, unnest(string_split(text, ' ')) as w, unnest(range(len(string_split(text, ' ')))) as i from conversations),
wo as (select *, coalesce(sum(length(w) + 1) over (partition by conv_id, turn order by i rows between unbounded preceding and 1 preceding), 0)::int as text_start from w),
wn as (select *, row_number() over (partition by conv_id, turn order by i) as n from wo where w <> ''),
m as (select conv_id, turn, shift + p as position, (1 + length(ch) + (shift + p) % 3)::int as n_symbols, row_number() over (partition by conv_id, turn order by shift + p) as mark from c where ch in (',', 'e', '?')),
z as (select gn.conv_id, gn.turn, gn.sentence, wn.i as word, wn.text_start, length(wn.w)::int as text_length, gn.start, gn."end", gn.shift from gn join wn using (conv_id, turn, n))
select z.conv_id, z.turn, z.sentence::int as sentence, z.word::int as word, text_start, text_length, z.start, z."end", coalesce(min_by(m.n_symbols, m.mark), 0)::int as n_punct
from z left join m on m.conv_id = z.conv_id and m.turn = z.turn and m.position >= z.start + z.shift and m.position < z."end" + z.shift group by all""")
def word_phoneme_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole turns and the groups of symbols of their sentences, with the first mark in each group."""
    key = ["conv_id", "turn"]
    turns = read(spark, sf_dir, "conversations").select(*key, "text")
    sentences = turns.select(*key, F.posexplode(F.split("text", r"\. ")).alias("sentence", "s")).select(*key, "sentence", F.when(F.length("s") > 0, F.split("s", "")).otherwise(F.array().cast("array<string>")).alias("symbols"))
    before = F.coalesce(F.sum(F.length("w") + 1).over(Window.partitionBy(*key).orderBy("word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    words = turns.select(*key, F.posexplode(F.split("text", " ")).alias("word", "w")).select(*key, "word", before.alias("text_start"), F.length("w").alias("text_length")).where("text_length > 0")
    symbols = turns.select(*key, F.posexplode(F.split(F.replace(F.col("text"), F.lit(". "), F.lit("")), "")).alias("position", "ch")).where("ch in (',', 'e', '?')")
    marks = symbols.select(*key, F.col("position").alias("mark"), "position", (F.lit(2) + F.col("position") % 3).alias("n_symbols"))
    return map_words(sentences, words, marks, key)


@R.query("""
with c as (select c_custkey, c_mktsegment, round(c_acctbal, 0)::bigint as v from customer where c_custkey % 3 = 0),
p as (select c_mktsegment as profile, count(*) as n, sum(v)::bigint as extra from c group by 1)
select c_custkey, coalesce(a.extra, d.extra, 0) as extra from (select c_custkey, case when c_custkey % 5 = 0 then 'NONE' else c_mktsegment end as profile from customer) q
left join p a using (profile) left join (select extra from p where profile = 'MACHINERY') d on true""")
def profile_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile by name, else the default one."""
    customers = read(spark, sf_dir, "customer")
    profiles = customers.where("c_custkey % 3 = 0").groupBy(F.col("c_mktsegment").alias("profile")).agg(F.sum(F.round("c_acctbal", 0).cast("long")).alias("extra"))
    asked = customers.selectExpr("c_custkey", "case when c_custkey % 5 = 0 then 'NONE' else c_mktsegment end as profile").withColumn("fallback", F.lit("MACHINERY"))
    default = profiles.select(F.col("profile").alias("fallback"), F.col("extra").alias("usual"))
    return asked.join(profiles, "profile", "left").join(default, "fallback", "left").select("c_custkey", F.coalesce("extra", "usual", F.lit(0)).alias("extra"))


@R.query("""
select vec_id, list_transform(range(8), lambda i: round(case when i < 4 then sin(vec_id::double * exp(-i * ln(10000.0::double) / 3)) else cos(vec_id::double * exp(-(i - 4) * ln(10000.0::double) / 3)) end, 6)) as signal from embeddings""")
def timing_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sines, then cosines, of a position at four scales from 1 to 10,000."""
    import math

    angle = lambda i: F.col("vec_id").cast("double") * F.exp(-i * math.log(10_000.0) / 3)
    wave = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.round(F.when(i < 4, F.sin(angle(i))).otherwise(F.cos(angle(i - 4))), 6))
    return read(spark, sf_dir, "embeddings").select("vec_id", wave.alias("signal"))


@R.query("""
with d as (select conv_id, count(*) as n from conversations group by conv_id)
select conv_id, n, list_transform(range(n), lambda i: list_transform(range(n), lambda j: j <= i)) as mask, list_transform(range(n), lambda i: list_transform(range(n), lambda j: round(-ln(1 + abs(i - j)), 6) + 0.0)) as bias from d""")
def attention_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causal mask and the proximal bias of each conversation's turns."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    at = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    mask = F.transform(at, lambda i: F.transform(at, lambda j: j <= i))
    bias = F.transform(at, lambda i: F.transform(at, lambda j: F.round(-F.ln(1 + F.abs(i - j)), 6) + 0.0))
    return turns.select("conv_id", "n", mask.alias("mask"), bias.alias("bias"))


@R.query("select vec_id, list_slice(embedding, trunc((vec_id % 20)::double / greatest(40, 1) * 64)::int + 1, 64)[1:5] as kept, trunc((vec_id % 20)::double / 40 * 64)::int as cut from embeddings")
def ref_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples after the share of a sequence that its reference takes."""
    cut = ((F.col("vec_id") % 20).cast("double") / 40 * 64).cast("int")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.slice("embedding", cut + 1, 64), 1, 5).alias("kept"), cut.alias("cut"))


@R.query("select vec_id, embedding[vec_id % 48 + 1:vec_id % 48 + 16] as segment from embeddings")
def segment_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", (F.col("vec_id") % 48 + 1).cast("int"), 16).alias("segment"))


@R.query("""
select event_id, list_filter(range(12), lambda i: case event_id % 6 when 0 then false when 1 then true when 2 then i % 2 = 0 when 3 then i >= 12 - 4 when 4 then i < 3 else i between 2 and 5 end) as layers from events""")
def layer_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices that a selector (none, all, even, last4, first3, 2-5) names."""
    spec = F.expr("case event_id % 6 when 0 then 'none' when 1 then 'all' when 2 then 'even' when 3 then 'last4' when 4 then 'first3' else '2-5' end")
    number = lambda pattern, group=1: F.regexp_extract("spec", pattern, group).try_cast("int")
    chosen = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: (
        F.when(F.col("spec").isin("none", "off", "disabled"), False).when(F.col("spec") == "all", True).when(F.col("spec") == "even", i % 2 == 0).when(F.col("spec") == "odd", i % 2 == 1)
        .when(F.startswith("spec", F.lit("last")), i >= 12 - number(r"^last(\d+)$")).when(F.startswith("spec", F.lit("first")), i < number(r"^first(\d+)$"))
        .otherwise(i.between(number(r"^(\d+)-(\d+)$"), number(r"^(\d+)-(\d+)$", 2)))))
    return read(spark, sf_dir, "events").select("event_id", spec.alias("spec")).select("event_id", F.transform(chosen, lambda i: i.cast("long")).alias("layers"))


@R.query("""
with s as (select o_orderkey, least(360, 60 + o_orderkey % 400) as cap, o_totalprice / 10000 as raw_seconds from orders)
select o_orderkey, raw_seconds >= greatest(0, cap / 12.0::double - 0.25) as hit from s""")
def hit_token_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "least(360, 60 + o_orderkey % 400) as cap", "o_totalprice / 10000 as raw_seconds")
    return caps.select("o_orderkey", (F.col("raw_seconds") >= F.greatest(F.lit(0.0), F.col("cap") / 12.0 - 0.25)).alias("hit"))


@R.query("""
with v as (select p_partkey, p_brand, string_split(p_name, ' ') as variants from part), k as (select distinct string_split(p_name, ' ')[1] as word from part where p_partkey % 2 = 0)
select p_partkey, bool_and(x in (select word from k)) as known from (select p_partkey, unnest(variants) as x from v) group by p_partkey""")
def variants_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a vocabulary has all variants of a word: division by counting what it has not."""
    parts = read(spark, sf_dir, "part")
    variants = parts.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    known = parts.where("p_partkey % 2 = 0").select(F.substring_index("p_name", " ", 1).alias("word")).distinct().withColumn("found", F.lit(True))
    return variants.join(known, "word", "left").groupBy("p_partkey").agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("known"))


@R.query("""
with e as (select user_id, event_id, value, sum(value) over (partition by user_id order by event_id rows unbounded preceding) as cum from events)
select user_id, event_id, round(coalesce(lag(cum) over (partition by user_id order by event_id), 0), 4) as begin, round(cum, 4) as finish from e""")
def offset_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = read(spark, sf_dir, "events").withColumn("cum", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("user_id", "event_id", F.round(F.coalesce(F.lag("cum").over(w), F.lit(0.0)), 4).alias("begin"), F.round("cum", 4).alias("finish"))


@R.query("""
with g as (select label, list(vec_id order by vec_id) as ids from embeddings group by label)
select label, len(ids) as n, md5(array_to_string(ids, ',')) as ids_md5 from g""")
def set_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each group in their order as one."""
    parts = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return parts.select("label", F.size("ids").cast("long").alias("n"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


QUERIES, ORACLE_SQL = R.queries, R.sql
