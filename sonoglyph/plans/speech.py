"""Queries over words and tokens, sample arrays, speakers, listings and records."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sonoglyph.dims import PHONEMES
from sonoglyph.functions import audio as A, signal as G, text as X
from sonoglyph.operators import phoneme as P, route as O, spans as N
from sonoglyph.plans.registry import Registry, read, sql_rows
from sonoglyph.sources.wav import build_wav

R = Registry()
_WORDS = r"""r as (select conv_id, turn, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}]+')) as word, unnest(range(len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+|[^\p{L}\p{M}\p{N}\p{Pc}]+')))) as pos from conversations),
w as (select conv_id, turn, word, (s - length(word))::bigint as start, s::bigint as "end" from (select *, sum(length(word)) over (partition by conv_id, turn order by pos) as s from r) where regexp_matches(word, '^[\p{L}\p{M}\p{N}\p{Pc}]'))"""


@R.query(f'with {_WORDS} select conv_id, turn, word, start, "end" from w')
def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each turn with their places."""
    return N.word_offsets(read(spark, sf_dir, "conversations"), ["conv_id", "turn"])


@R.query(f"""
with {_WORDS}, t as (select conv_id, turn, unnest(range(0, length(text), 4)) as s, length(text) as n from conversations)
select w.conv_id, w.turn, w.start, count(*) as n_tokens, min(s // 4)::bigint as first_token from w join t on t.conv_id = w.conv_id and t.turn = w.turn and s < "end" and least(s + 4, n) > start group by all""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of four characters that words overlap."""
    turns = read(spark, sf_dir, "conversations")
    tokens = turns.select("conv_id", "turn", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(4))).alias("token", "token_start"), F.length("text").alias("n"))
    tokens = tokens.withColumn("token_end", F.least(F.col("token_start") + 4, F.col("n"))).drop("n")
    words = N.word_offsets(turns, ["conv_id", "turn"])
    return N.overlapping(words, tokens, ["conv_id", "turn"]).groupBy("conv_id", "turn", "start").agg(F.count(F.lit(1)).alias("n_tokens"), F.min("token").cast("long").alias("first_token"))


@R.query("""
with recursive k as (select conv_id, turn, text, list_transform(string_split(text, ' '), lambda t, i: case when i % 4 = 0 then 'zzz' else t end) as tokens from conversations),
f as (select conv_id, turn, text, tokens, 0 as i, 0 as pos, null::int as start, null::int as stop from k
  union all select conv_id, turn, text, tokens, i + 1, case when here > 0 then pos + here - 1 + length(tokens[i + 1]) else pos end, case when here > 0 then pos + here - 1 end, case when here > 0 then pos + here - 1 + length(tokens[i + 1]) end
  from (select *, strpos(substr(text, pos + 1), tokens[i + 1]) as here from f where i < len(tokens)))
select conv_id, turn, count(start) as n_found, coalesce(sum(start), 0)::bigint as starts, coalesce(max(stop), 0)::int as last_end from f group by conv_id, turn""")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens found one after the other; every fourth is not in the text."""
    tokens = F.transform(F.split("text", " "), lambda t, i: F.when((i + 1) % 4 == 0, "zzz").otherwise(t))
    found = read(spark, sf_dir, "conversations").select("conv_id", "turn", N.token_offsets(F.col("text"), tokens).alias("f"))
    total = F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x["start"])
    return found.select("conv_id", "turn", F.size("f").cast("long").alias("n_found"), total.alias("starts"), F.coalesce(F.array_max(F.transform("f", lambda x: x["end"])), F.lit(0)).alias("last_end"))


@R.query("""
with s as (select p_partkey, string_split(p_name, ' ') as w from part),
x as (select p_partkey, array_to_string(list_transform(w, lambda x, i: case when i % 2 = 0 then '<w>' || case when ends_with(x, 'e') then 'e' else '' end else x end), ' ') as t from s)
select p_partkey, t as spliced from x""")
def spliced_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second word's symbols replaced but for a last ``e``, which counts as its mark."""
    words = F.split("p_name", " ")
    begin = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.aggregate(F.slice(words, 1, i), F.lit(0), lambda a, w: a + F.length(w) + 1))
    spans = F.zip_with(words, begin, lambda w, b: F.struct(b.alias("start"), (b + F.length(w)).alias("end"), F.when(F.endswith(w, F.lit("e")), 1).otherwise(0).alias("marks")))
    spans = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["marks"].alias("marks"), F.when(i % 2 == 1, F.array(F.lit("<"), F.lit("w"), F.lit(">"))).alias("instead")))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", "").alias("symbols"), spans.alias("words"))
    return rows.select("p_partkey", F.array_join(N.splice(F.col("symbols"), F.col("words")), "").alias("spliced"))


_MANY = {s: [i, i + 200] if s in "aeiou" else [i] for i, s in enumerate(PHONEMES) if s in "abcdefghijklmnopqrstuvwxyz "}


@R.query(f"""
with m(symbol, a, b) as (values {sql_rows([(s, v[0], v[-1]) for s, v in _MANY.items()])}),
p as (select p_partkey, unnest(string_split(p_name, '')) as symbol, unnest(range(len(string_split(p_name, '')))) as pos from part),
k as (select p_partkey, list(case when a = b then [a, 0] else [a, b, 0] end order by pos) as ids from p join m using (symbol) group by p_partkey)
select p_partkey, [1, 0] || flatten(ids) || [2] as ids from k""")
def many_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of two ids among those of one."""
    return read(spark, sf_dir, "part").select("p_partkey", N.mapped_ids(F.split("p_name", ""), _MANY).alias("ids"))


@R.query("select vec_id, [0.0::double] || flatten(list_transform(embedding, lambda x: [round(x::double, 6), 0.0])) as padded from embeddings")
def interspersed(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.transform("embedding", lambda x: A.rounded(x.cast("double"), 6))
    return read(spark, sf_dir, "embeddings").select("vec_id", P.intersperse(values, F.lit(0.0)).alias("padded"))


@R.query("select p_partkey, case p_partkey % 3 when 0 then lower(p_brand) when 1 then upper(p_name) else p_name end as cased from part")
def casing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cased = F.when(F.col("p_partkey") % 3 == 0, F.lower("p_brand")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", cased.alias("cased"))


# Marks that end a clause and a sentence.
_CLAUSES = {"period": (".", True), "question": ("?", True), "exclamation": ("!", True), "comma": (", ", False), "colon": (": ", False), "semicolon": ("; ", False)}


@R.query("""
with t as (select event_id, user_id, case event_id % 7 when 0 then 'period' when 1 then 'question' when 2 then 'exclamation' when 3 then 'comma' when 4 then 'colon' when 5 then 'semicolon' else 'none' end as kind from events),
m as (select *, case kind when 'period' then '.' when 'question' then '?' when 'exclamation' then '!' when 'comma' then ', ' when 'colon' then ': ' when 'semicolon' then '; ' else '' end as mark, kind in ('period', 'question', 'exclamation') as ends from t)
select event_id, mark, least(length(mark), 1) as n_marks, coalesce(sum(ends::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0)::bigint as sentence from m""")
def clause_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of clauses by kind, and the sentence that each clause is in."""
    kind = F.expr("case event_id % 7 when 0 then 'period' when 1 then 'question' when 2 then 'exclamation' when 3 then 'comma' when 4 then 'colon' when 5 then 'semicolon' else 'none' end")
    table = F.create_map(*(x for k, (m, e) in _CLAUSES.items() for x in (F.lit(k), F.struct(F.lit(m).alias("mark"), F.lit(e).alias("ends")))))
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", F.element_at(table, kind).alias("c"))
    ends = F.sum(F.coalesce(F.col("c.ends"), F.lit(False)).cast("int")).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    mark = F.coalesce("c.mark", F.lit(""))
    return rows.select("event_id", mark.alias("mark"), F.least(F.length(mark), F.lit(1)).cast("long").alias("n_marks"), F.coalesce(ends, F.lit(0)).alias("sentence"))


@R.query("""
with t as (select label, row_number() over (partition by label order by vec_id) - 1 as token, embedding as v from embeddings),
w as (select distinct label, label * 3 + 1 as start, label * 3 + 1 + (label % 3) * 4 as stop from embeddings),
m as (select t.label, t.v, t.token * 4 < stop and t.token * 4 + 4 > start as hit from t join w using (label) where (t.token * 4 < stop and t.token * 4 + 4 > start) or t.token = 0),
u as (select label, hit, unnest(v)::double as x, unnest(range(len(v))) as i from m),
a as (select label, i, coalesce(avg(x) filter (where hit), avg(x)) as x from u group by label, i)
select label, list(round(x, 6) order by i) as vector from a group by label""")
def word_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of the tokens that a word overlaps, else that of token 0; a label's vectors are a text's tokens."""
    rows = read(spark, sf_dir, "embeddings")
    token = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    tokens = rows.select("label", token.alias("token"), (token * 4).alias("token_start"), (token * 4 + 4).alias("token_end"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    words = rows.select("label").distinct().selectExpr("label", "label * 3 + 1 as start", "label * 3 + 1 + (label % 3) * 4 as end")
    return N.word_vectors(words, tokens, ["label"]).select("label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@R.query("""
with s as (select vec_id, unnest(range(8)) as pos, unnest(embedding[1:8]) as score from embeddings),
k as (select *, row_number() over (partition by vec_id order by case when pos % 3 = vec_id % 3 then '-inf'::float else score end desc, pos) as k from s)
select vec_id, pos::int as variant from k where k = 1""")
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant of the best score, the first of equals; masked ones never win against others."""
    scores = F.transform(F.slice("embedding", 1, 8), lambda x, i: F.struct(F.when(i % 3 == F.col("vec_id") % 3, float("-inf")).otherwise(x).alias("score"), (-i).alias("o")))
    return read(spark, sf_dir, "embeddings").select("vec_id", (-F.array_max(scores)["o"]).alias("variant"))


@R.query("""
with s as (select vec_id, list_transform(range(1, 33), lambda i: round((embedding[i]::double + embedding[i + 32]::double) / 2, 6)) as m from embeddings)
select vec_id, m || list_transform(range(12), lambda i: 0.0::double) as samples from s""")
def reference_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels as one by their mean, with half a second of silence (here at 24 samples a second) after it."""
    mono = F.zip_with(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), lambda a, b: (a.cast("double") + b.cast("double")) / 2)
    mono = F.transform(mono, lambda x: A.rounded(x, 6))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.concat(mono, F.array_repeat(F.lit(0.0), int(0.5 * 24))).alias("samples"))


@R.query("select vec_id, ((44 + 2 * len(embedding) + 2) // 3 * 4)::bigint as n_chars, 'UklGR' as head from embeddings")
def wav_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 16-bit samples as base64 text."""
    samples = F.transform("embedding", lambda x: (x * 1000).cast("smallint"))
    coded = read(spark, sf_dir, "embeddings").select("vec_id", F.base64(build_wav(samples, F.lit(24_000))).alias("b"))
    return coded.select("vec_id", F.length(F.regexp_replace("b", r"\s", "")).cast("long").alias("n_chars"), F.left("b", F.lit(5)).alias("head"))


@R.query("select l_orderkey, greatest(sum(ceil(round(exp(l_discount * 10 - 2) * 1.1, 6))), 1)::bigint as frames from lineitem group by l_orderkey")
def frame_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each utterance: its tokens' durations, each rounded up, and 1 at least."""
    frames = F.sum(F.ceil(F.round(F.exp(F.col("l_discount") * 10 - 2) * 1.1, 6)))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.greatest(frames, F.lit(1)).cast("long").alias("frames"))


@R.query("""
with s as (select user_id, count(*) filter (where event_type <> 'x') as steps, sum(case when event_id % 50 = 0 then 0 else value end) / 1000 as seconds from events group by user_id)
select user_id, round(case when steps > 0 then seconds / steps * 1000 else 0 end, 4) as ms_per_step, round(case when seconds > 0 then steps / seconds else 0 end, 4) as steps_per_s from s""")
def step_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "x").alias("steps"), (F.sum(F.when(F.col("event_id") % 50 == 0, 0.0).otherwise(F.col("value"))) / 1000).alias("seconds"))
    per = F.when(F.col("steps") > 0, F.col("seconds") / F.col("steps") * 1000).otherwise(0.0)
    return sums.select("user_id", F.round(per, 4).alias("ms_per_step"), F.round(F.when(F.col("seconds") > 0, F.col("steps") / F.col("seconds")).otherwise(0.0), 4).alias("steps_per_s"))


@R.query("""
with b as (select o_custkey as c_custkey, count(*) as n, ceil(avg(o_totalprice) / 1000)::bigint as tokens from orders group by 1)
select c_custkey, coalesce(tokens, 1) as estimated_tokens, case when tokens is null then 1 else greatest(1, floor(tokens * 0.9)::bigint) end as min_tokens, case when tokens is null then 1 else floor(tokens * 1.25)::bigint + 36 end as max_tokens, coalesce(n, 0) as samples
from customer left join b using (c_custkey)""")
def empty_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of all askers; who has nothing to say has one token and no sample."""
    made = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.avg("o_totalprice") / 1000).alias("tokens"))
    joined = read(spark, sf_dir, "customer").select("c_custkey").join(made, "c_custkey", "left")
    one = lambda c: F.when(F.col("tokens").isNull(), 1).otherwise(c)
    return joined.select("c_custkey", F.coalesce("tokens", F.lit(1)).alias("estimated_tokens"), one(F.greatest(F.lit(1), F.floor(F.col("tokens") * 0.9))).alias("min_tokens"), one(F.floor(F.col("tokens") * 1.25) + 36).alias("max_tokens"), F.coalesce("n", F.lit(0)).alias("samples"))


_SPEAKERS = "case n_nationkey % 5 when 0 then 'en-us' when 1 then 'zh' when 2 then 'fr' when 3 then lower(n_name) else 'de' end"
_LANG = "case c_custkey % 7 when 0 then 'en' when 1 then 'zh-cn' when 2 then 'fr' when 3 then 'xx' when 4 then 'yue' when 5 then 'gl' else 'de-at' end"
_VOICE = "case when l = '' then 'en-us' when b = 'yue' or l in ('zh-hk', 'zh-yue') then 'yue' when b in ('zh', 'cmn') then 'cmn-latn-pinyin' when b in ('jv', 'su') then 'id' when b = 'gl' then 'es' when b = 'mn' then 'ru' when l = 'en' then 'en-us' else b end"


@R.query(f"""
with s as (select {_SPEAKERS} as candidate, min(n_nationkey)::bigint as id from nation group by 1), m as (select lower(r_name) as base, 'fr' as candidate from region union all select 'es', 'de'),
l as (select c_custkey, l, string_split(replace(l, '_', '-'), '-')[1] as b from (select c_custkey, {_LANG} as l from customer)),
v as (select c_custkey, l, {_VOICE} as voice from l), k as (select *, case when starts_with(voice, 'en') then 'en' else voice end as base from v),
c as (select c_custkey, 0 as prio, m.candidate from k join m using (base)
  union all select c_custkey, i, list_extract(case when base = 'cmn' or starts_with(base, 'cmn-latn') then ['zh', 'cmn-latn-pinyin'] when starts_with(base, 'en') then ['en', 'en-us', 'en-gb'] else [base] end, i::int) from k, (select unnest(range(1, 4)) as i))
select customer.c_custkey, min_by(c.candidate, prio) filter (where id is not null) as speaker, min_by(id, prio) filter (where id is not null) as speaker_id from customer left join c using (c_custkey) left join s using (candidate) group by 1""")
def speaker_for_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speaker of a language: the one its voice's base is mapped to, else the first of its candidates that is known."""
    known = read(spark, sf_dir, "nation").groupBy(F.expr(_SPEAKERS).alias("candidate")).agg(F.min("n_nationkey").cast("long").alias("speaker_id"))
    mapped = read(spark, sf_dir, "region").selectExpr("lower(r_name) as base", "'fr' as mapped").union(spark.createDataFrame([("es", "de")], "base string, mapped string"))
    asked = read(spark, sf_dir, "customer").select("c_custkey", X.voice_of(F.expr(_LANG)).alias("voice"))
    asked = asked.withColumn("base", F.when(F.startswith("voice", F.lit("en")), "en").otherwise(F.col("voice"))).join(mapped, "base", "left")
    some = F.when(F.startswith("base", F.lit("cmn")), F.array(F.lit("zh"), F.lit("cmn-latn-pinyin"))).when(F.startswith("base", F.lit("en")), F.array(F.lit("en"), F.lit("en-us"), F.lit("en-gb"))).otherwise(F.array("base"))
    tried = asked.select("c_custkey", F.posexplode(F.concat(F.array("mapped"), some)).alias("prio", "candidate")).join(known, "candidate")
    best = tried.groupBy("c_custkey").agg(F.min_by(F.struct("candidate", "speaker_id"), "prio").alias("s"))
    return asked.select("c_custkey").join(best, "c_custkey", "left").select("c_custkey", F.col("s.candidate").alias("speaker"), F.col("s.speaker_id").alias("speaker_id"))


@R.query(f"""
with m as (select {_SPEAKERS} as speaker, max_by(n_name, n_nationkey) as language from nation group by 1), q as (select s_suppkey, case when s_suppkey % 3 = 0 then 'nobody' when s_suppkey % 3 = 1 then 'zh' else 'de' end as speaker from supplier)
select s_suppkey, coalesce(language, speaker) as language from q left join m using (speaker)""")
def speaker_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that a speaker is mapped from, the last one of several; without one the speaker's own label."""
    mapped = read(spark, sf_dir, "nation").groupBy(F.expr(_SPEAKERS).alias("speaker")).agg(F.max_by("n_name", "n_nationkey").alias("language"))
    asked = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", "case when s_suppkey % 3 = 0 then 'nobody' when s_suppkey % 3 = 1 then 'zh' else 'de' end as speaker")
    return asked.join(mapped, "speaker", "left").select("s_suppkey", F.coalesce("language", "speaker").alias("language"))


_DP = "case c_custkey % 6 when 0 then 'EN_us' when 1 then 'fr-FR' when 2 then ' auto ' when 3 then 'KENYA-x' when 4 then 'qq' else 'ES-mx' end"


@R.query(f"""
with k as (select case n_nationkey when 0 then 'en-us' when 1 then 'es' else lower(n_name) end as candidate, n_nationkey::bigint as id from nation), m as (select 'fr-FR' as lang, 'peru' as to_ union all select 'kenya', 'kenya'),
q as (select c_custkey, case when lower(trim(l)) in ('', 'auto', 'multilingual') then 'en-us' else replace(trim(l), '_', '-') end as n from (select c_custkey, {_DP} as l from customer)),
b as (select *, lower(string_split(n, '-')[1]) as base from q),
t as (select c_custkey, 0 as prio, n as candidate from b union all select c_custkey, 1, lower(n) from b union all select c_custkey, 2, to_ from b join m on lang = n union all select c_custkey, 3, to_ from b join m on lang = lower(n) union all select c_custkey, 4, base from b union all select c_custkey, 5, to_ from b join m on lang = base)
select c.c_custkey, coalesce(min_by(k.id, prio) filter (where k.id is not null), 0) as speaker_id from customer c left join t using (c_custkey) left join k using (candidate) group by 1""")
def dp_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of six candidates that has an id: the language as it is and in lower case, what both map to, its base, what
    that maps to; else the map's first value."""
    known = read(spark, sf_dir, "nation").selectExpr("case n_nationkey when 0 then 'en-us' when 1 then 'es' else lower(n_name) end as candidate", "cast(n_nationkey as bigint) as speaker_id")
    table = F.create_map(F.lit("fr-FR"), F.lit("peru"), F.lit("kenya"), F.lit("kenya"))
    asked = read(spark, sf_dir, "customer").select("c_custkey", F.expr(_DP).alias("l"))
    asked = asked.withColumn("n", F.when(F.lower(F.trim("l")).isin("", "auto", "multilingual"), "en-us").otherwise(F.replace(F.trim("l"), F.lit("_"), F.lit("-"))))
    low, base = F.lower("n"), F.lower(F.substring_index("n", "-", 1))
    tried = F.array("n", low, F.element_at(table, F.col("n")), F.element_at(table, low), base, F.element_at(table, base))
    return O.first_candidate(asked, ["c_custkey"], tried, known, "speaker_id", F.lit(0)).select("c_custkey", "speaker_id")


_RAW = """case when c_custkey % 5 = 0 then '  ' when c_custkey % 5 = 1 then '[1]' else '{"en-US": {"min_margin": 0.5, "junk": 1, "max_extra_tokens": ' || (c_custkey % 50) || '}, "fra": {"max_margin": ' || (c_custkey % 3) || '.5}, "xx_YY": {}, "eng": {"min_extra_tokens": ' || (c_custkey % 7) || '}}' end"""


@R.query("""
select c_custkey, 'english' as language, null::double as min_margin, null::double as max_margin, (c_custkey % 7)::int as min_extra_tokens, null::int as max_extra_tokens from customer where c_custkey % 5 > 1
union all select c_custkey, 'french', null, (c_custkey % 3) + 0.5::double, null, null from customer where c_custkey % 5 > 1 union all select c_custkey, 'xx-yy', null, null, null, null from customer where c_custkey % 5 > 1""")
def json_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget profiles from JSON: four known fields of each language, languages by their names, of equal ones the last."""
    kind = "map<string,struct<min_margin:double,max_margin:double,min_extra_tokens:int,max_extra_tokens:int>>"
    parsed = read(spark, sf_dir, "customer").select("c_custkey", F.from_json(F.expr(_RAW), kind).alias("p"))
    rows = parsed.select("c_custkey", F.posexplode(F.map_entries("p")).alias("pos", "e"))
    last = rows.groupBy("c_custkey", X.language_key(F.col("e.key")).alias("language")).agg(F.max_by("e.value", "pos").alias("v"))
    return last.select("c_custkey", "language", "v.*")


@R.query("""
select s_suppkey, 'Ab ' || s_suppkey as text, case when s_suppkey % 2 = 0 then 'given' else 'ab ' || s_suppkey end as processed_text, case when s_suppkey % 3 = 0 then ['x'] else string_split(case when s_suppkey % 2 = 0 then 'given' else 'ab ' || s_suppkey end, '') end as phonemes from supplier""")
def enriched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON with what they lack: the text in lower case, and its symbols."""
    fields = F.struct(F.concat(F.lit("Ab "), F.col("s_suppkey")).alias("text"), F.when(F.col("s_suppkey") % 2 == 0, "given").alias("processed_text"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("x"))).alias("phonemes"))
    lines = read(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(fields).alias("line"))
    u = lines.select("s_suppkey", F.from_json("line", "text string, processed_text string, phonemes array<string>").alias("u"))
    processed = F.coalesce("u.processed_text", F.lower("u.text"))
    return u.select("s_suppkey", "u.text", processed.alias("processed_text"), F.coalesce("u.phonemes", F.split(processed, "")).alias("phonemes"))


@R.query("""
with e as (select event_id, case event_id % 4 when 0 then 'queued' when 1 then 'chunk' when 2 then 'done' else 'error' end as kind, round(value, 2) as v from events)
select event_id, kind, case when kind = 'queued' then event_id % 10 end as position, case when kind in ('chunk', 'done') then v end as ms, case when kind = 'error' then 'failed at ' || event_id end as message from e""")
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of four kinds as JSON, and read again as one union."""
    kind = F.expr("case event_id % 4 when 0 then 'queued' when 1 then 'chunk' when 2 then 'done' else 'error' end")
    body = F.to_json(F.struct(kind.alias("type"), F.when(kind == "queued", F.col("event_id") % 10).alias("position"), F.when(kind.isin("chunk", "done"), F.round("value", 2)).alias("ms"), F.when(kind == "error", F.concat(F.lit("failed at "), "event_id")).alias("message")))
    got = read(spark, sf_dir, "events").select("event_id", F.from_json(body, "type string, position long, ms double, message string").alias("m"))
    return got.select("event_id", F.col("m.type").alias("kind"), "m.position", "m.ms", "m.message")


@R.query("""
with v as (select conv_id, turn, [length(text) / 100.0::double, turn::double, 1.0, (length(text) % 7)::double] as v from conversations),
s as (select a.conv_id, a.turn, b.turn as other, b.v, case when b.turn <= a.turn then list_sum(list_transform(range(1, 5), lambda i: a.v[i] * b.v[i])) / 2 else -1e4 end as s from v a join v b using (conv_id)),
e as (select *, exp(s - max(s) over (partition by conv_id, turn)) as e from s)
select conv_id, turn, round(sum(e * v[1]) / sum(e), 6) as x, round(sum(e * v[4]) / sum(e), 6) as y from e group by conv_id, turn""")
def masked_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled dot products of each turn with the turns of its conversation, those after it masked; softmax; weighted sum."""
    parts = F.array(F.length("text") / 100.0, F.col("turn").cast("double"), F.lit(1.0), (F.length("text") % 7).cast("double"))
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", parts.alias("v")))).alias("t"))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    # all rows of a conversation within its own row: nothing is copied for each of them
    scores = lambda q: F.transform("t", lambda k: F.when(k["turn"] <= q["turn"], add(F.zip_with(q["v"], k["v"], lambda a, b: a * b)) / 2).otherwise(-1e4))
    powers = lambda s: X.let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
    mean = lambda e, i: F.round(add(F.zip_with(e, "t", lambda x, k: x * k["v"][i])) / add(e), 6)
    row = lambda q: X.let(powers(scores(q)), lambda e: F.struct(q["turn"].alias("turn"), mean(e, 0).alias("x"), mean(e, 3).alias("y")))
    rows = turns.select("conv_id", F.transform("t", row).alias("r"))
    return rows.select("conv_id", F.explode("r").alias("r")).select("conv_id", "r.*")


@R.query("select event_id, round(-ln(-ln(((event_id * 7919) % 1000) / 1000.0::double * 0.99998 + 0.00001)), 6) as g from events")
def gumbel(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ((F.col("event_id") * 7919) % 1000) / 1000.0
    return read(spark, sf_dir, "events").select("event_id", F.round(-F.ln(-F.ln(u * 0.99998 + 0.00001)), 6).alias("g"))


@R.query("""
with n as (select label, pow(list_sum(list_transform(embedding, lambda x: pow(abs(x::double), 3))), 1.0 / 3) as n, list_max(list_transform(embedding, lambda x: least(0.1, greatest(-0.1, x::double)))) as top from embeddings)
select label, round(pow(sum(pow(n, 3)), 1.0 / 3), 6) as norm, round(max(top), 6) as top from n group by label""")
def clipped_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3-norm of each label's vectors together, and their largest component once clipped to a tenth."""
    rows = read(spark, sf_dir, "embeddings").select("label", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x.cast("double")), 3)).alias("p"), F.array_max(F.transform("embedding", lambda x: F.least(F.lit(0.1), F.greatest(F.lit(-0.1), x.cast("double"))))).alias("top"))
    return rows.groupBy("label").agg(F.round(F.pow(F.sum("p"), 1.0 / 3), 6).alias("norm"), F.round(F.max("top"), 6).alias("top"))


@R.query("""
with s as (select user_id, row_number() over (partition by user_id order by event_id) - 1 as step, case when event_type = 'purchase' then 2 else 5 end as token, 10 + user_id % 40 as most, user_id % 7 as prefill from events),
e as (select user_id, min(step) as stop from s where token = 2 group by user_id)
select s.user_id, count(*) as n_steps from s left join e using (user_id) where step < least(most, 45 - 1 - prefill) and step < coalesce(stop, 1000000000) group by s.user_id""")
def limited_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps before the end id, the most that were asked for, and the end of the model's positions."""
    steps = read(spark, sf_dir, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("step"), F.when(F.col("event_type") == "purchase", 2).otherwise(5).alias("token"))
    ended = F.max((F.col("token") == 2).cast("int")).over(Window.partitionBy("user_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    most = F.least(10 + F.col("user_id") % 40, 45 - 1 - F.col("user_id") % 7)
    return steps.withColumn("ended", ended).where((F.col("ended") == 0) & (F.col("step") < most)).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_steps"))


@R.query("""
with l as (select conv_id, turn, case when turn % 6 = 2 then '  ' when (conv_id + turn) % 9 = 0 then ' QUIT ' else text end as line from conversations),
s as (select conv_id, min(turn) as stop from l where lower(trim(line)) in ('exit', 'quit', 'stop') group by conv_id)
select l.conv_id, turn, 'out_' || lpad((row_number() over (partition by l.conv_id order by turn))::varchar, 4, '0') || '.wav' as file from l left join s using (conv_id) where trim(line) <> '' and turn < coalesce(stop, 1000000000)""")
def served_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not blank, up to the first that ends the session, with the file that each is written to."""
    lines = read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "case when turn % 6 = 2 then '  ' when (conv_id + turn) % 9 = 0 then ' QUIT ' else text end as line").withColumn("line", X.strip(F.col("line")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    over = F.max(F.lower("line").isin("exit", "quit", "stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    said = lines.withColumn("over", over).where("over = 0 and line <> ''")
    return said.select("conv_id", "turn", F.format_string("out_%04d.wav", F.row_number().over(w)).alias("file"))


@R.query("""
with f as (select 'data/m' || (s_suppkey % 30) || '/' || case s_suppkey % 4 when 0 then 'config.json' when 1 then 'model.onnx' else 'x/config.json' end as path from supplier)
select string_split(path, '/')[2] as model, row_number() over (order by string_split(path, '/')[2]) as place, count(*) as n_files from f group by 2 - 1, string_split(path, '/')[2] having bool_or(len(string_split(path, '/')) = 3 and ends_with(path, '/config.json'))""".replace("group by 2 - 1, ", "group by "))
def listed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of a listing that hold a configuration themselves, in order."""
    paths = read(spark, sf_dir, "supplier").selectExpr("'data/m' || (s_suppkey % 30) || '/' || case s_suppkey % 4 when 0 then 'config.json' when 1 then 'model.onnx' else 'x/config.json' end as path")
    parts = paths.withColumn("p", F.split("path", "/"))
    models = parts.groupBy(F.col("p")[1].alias("model")).agg(F.count(F.lit(1)).alias("n_files"), F.bool_or((F.size("p") == 3) & (F.col("p")[2] == "config.json")).alias("has"))
    return models.where("has").select("model", F.row_number().over(Window.orderBy("model")).cast("long").alias("place"), "n_files")  # one row a model


@R.query("""
with k as (select 'root/' || case when page_id % 10 = 0 then '' else regexp_extract(url, '//([^/]*)', 1) || '/' || page_id end as key, length(html) as size from pages)
select string_split(substr(key, 6), '/')[1] as model, count(*) as n, sum(size)::bigint as size from k where key <> 'root/' and contains(string_split(substr(key, 6), '/')[1], 'e') group by 1""")
def listed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a listing by model, the first part of their path; the root itself and other names are left out."""
    keys = read(spark, sf_dir, "pages").select(F.concat(F.lit("root/"), F.when(F.col("page_id") % 10 == 0, "").otherwise(F.concat(F.regexp_extract("url", "//([^/]*)", 1), F.lit("/"), "page_id"))).alias("key"), F.length("html").alias("size"))
    model = F.substring_index(F.expr("substring(key, 6)"), "/", 1)
    return keys.where("key <> 'root/'").groupBy(model.alias("model")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).where(F.contains("model", F.lit("e")))


@R.query("select lower(string_split(p_name, ' ')[1]) as word, max_by(p_brand, p_partkey) as variants, count(*) as n_lines from part group by 1")
def heteronym_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary from lines: words in lower case, of equal ones the last line's variants."""
    return read(spark, sf_dir, "part").groupBy(F.lower(F.substring_index("p_name", " ", 1)).alias("word")).agg(F.max_by("p_brand", "p_partkey").alias("variants"), F.count(F.lit(1)).alias("n_lines"))


@R.query("""
with c as (select user_id, (row_number() over (partition by user_id order by event_id) - 1) // 12 as chunk, event_type, value from events),
a as (select user_id, chunk, count(*) as n, sum(value) as ms from c group by all), d as (select a.user_id, a.chunk, count(distinct c.event_type) as seen from a join c on c.user_id = a.user_id and c.chunk <= a.chunk group by all)
select user_id, chunk, seen as n_history, round(case when chunk = 0 then ms / 10 else 0 end, 4) as prefill_ms from a join d using (user_id, chunk)""")
def chunk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of all chunks so far, which a penalty looks at; the time before the first step counts in chunk 0 alone."""
    steps = read(spark, sf_dir, "events").withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) / 12))
    first = steps.groupBy("user_id", "event_type").agg(F.min("chunk").alias("chunk")).groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("fresh"))
    sums = steps.groupBy("user_id", "chunk").agg(F.sum("value").alias("ms")).join(first, ["user_id", "chunk"], "left")
    seen = F.sum(F.coalesce("fresh", F.lit(0))).over(Window.partitionBy("user_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
    return sums.select("user_id", "chunk", seen.alias("n_history"), F.round(F.when(F.col("chunk") == 0, F.col("ms") / 10).otherwise(0.0), 4).alias("prefill_ms"))


@R.query("""
with p as (select o_custkey as c_custkey, list(round(o_totalprice, 2) order by o_orderkey) as s from orders group by 1)
select c_custkey, coalesce(s, [0.0::double]) as samples from customer left join p using (c_custkey)""")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each asker in order as one; who has none gets one sample of silence."""
    parts = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.array(F.round("o_totalprice", 2)).alias("x")))).alias("s"))
    joined = read(spark, sf_dir, "customer").select("c_custkey").join(parts, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce(F.flatten(F.transform("s", lambda v: v["x"])), F.array(F.lit(0.0))).alias("samples"))


@R.query("""
with s as (select l_orderkey, l_linenumber, string_split(l_returnflag || case when l_linenumber % 3 = 0 then '' else l_linestatus end, '') as t, l_linenumber % 4 = 0 as empty from lineitem)
select l_orderkey, string_agg(array_to_string(t, ''), ' ' order by l_linenumber, array_to_string(t, '')) filter (where not empty) as tokens from s group by l_orderkey""")
def joined_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of spans in order as one sequence, with a space between spans that have any."""
    tokens = F.when(F.col("l_linenumber") % 4 != 0, F.split(F.concat("l_returnflag", F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_linestatus"))), ""))
    spans = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tokens.alias("t"))
    listed = spans.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.when(F.size("t") > 0, F.struct("l_linenumber", "t")))).alias("s"))
    return listed.select("l_orderkey", F.nullif(F.array_join(F.transform("s", lambda v: F.array_join(v["t"], "")), " "), F.lit("")).alias("tokens"))


@R.query()
def mel_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log mel spectra of vectors as samples; compared with a direct transform in the tests."""
    mel = G.mel_spectrum(F.transform("embedding", lambda x: x.cast("double")), n_fft=32, hop=8, n_mels=6, rate=8000)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", mel.alias("m"))
    return rows.select("vec_id", F.size("m").alias("n_bands"), F.size(F.get("m", 0)).alias("n_frames"), F.transform(F.flatten("m"), lambda x: F.round(x, 6)).alias("mel"))


@R.query()
def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best monotonic paths through vectors as 4 tokens by 16 frames; compared with all paths in the tests."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", i * 16 + 1, 16), lambda x: x.cast("double")))
    return read(spark, sf_dir, "embeddings").select("vec_id", G.alignment(rows).alias("path"))


@R.query("""
with recursive e as (select vec_id, list_transform(embedding, lambda v: v::double * 8) as e, (2 + label % 5)::int as n, (7 + vec_id % 4)::int as t from embeddings),
v as (select vec_id, n, t, i, j, list_sum(list_transform(range(1, 5), lambda d: -0.5 * ln(2 * pi()) - e[39 + 4 * i + d] / 16 - 0.5 * pow(e[4 * j + d] - e[40 + 4 * i + d], 2) * exp(-2 * e[39 + 4 * i + d] / 16))) as score
  from e, (select unnest(range(6)) as i), (select unnest(range(10)) as j) where i < n and j < t),
w(vec_id, n, t, i, j, score, path) as (select vec_id, n, t, i, j, score, [i] from v where i = 0 and j = 0
  union all select v.vec_id, v.n, v.t, v.i, v.j, w.score + v.score, w.path || [v.i] from w join v on v.vec_id = w.vec_id and v.j = w.j + 1 and (v.i = w.i or v.i = w.i + 1))
select vec_id, max_by(path, score) as path, list_transform(range(n), lambda k: len(list_filter(max_by(path, score), lambda p: p = k))::bigint) as durations, round(max(score), 4) as score from w where j = t - 1 and i = n - 1 group by vec_id, n""")
def gaussian_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best monotonic paths of frames through tokens of normal distributions, of unequal numbers of both."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 8).alias("e"), (2 + F.col("label") % 5).cast("int").alias("n"), (7 + F.col("vec_id") % 4).cast("int").alias("t"))
    rows = lambda first, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice("e", first + 4 * k, 4))
    made = e.select("vec_id", "e", rows(1, F.col("t")).alias("z"), rows(41, F.col("n")).alias("m"), F.transform(rows(40, F.col("n")), lambda r: F.transform(r, lambda v: v / 16)).alias("s"))
    made = made.select("vec_id", "z", "m", "s", G.gaussian_alignment("z", "m", "s").alias("a"))
    density = lambda z, m, s: F.aggregate(F.arrays_zip(z.alias("z"), m.alias("m"), s.alias("s")), F.lit(0.0), lambda x, d: x - 0.5 * math.log(2 * math.pi) - d["s"] - 0.5 * (d["z"] - d["m"]) ** 2 * F.exp(-2 * d["s"]))
    score = F.aggregate(F.transform(F.col("a.path"), lambda i, j: density(F.get("z", j), F.get("m", i.cast("int")), F.get("s", i.cast("int")))), F.lit(0.0), lambda x, d: x + d)
    return made.select("vec_id", "a.path", "a.durations", F.round(score, 4).alias("score"))


QUERIES, ORACLE_SQL = R.queries, R.sql
