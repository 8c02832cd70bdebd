"""Queries over the environments of sessions and over speakers with their fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoglyph.operators import runtime as O
from sonoglyph.plans.registry import Registry, read, sql_rows

R = Registry()
_KEYS = ["PRECISION_MODE", "OPTIMIZED", *(f.upper() for f in [*O.STRINGS, *O.INTEGERS, *O.BOOLEANS])]
_SHIP = "case cast(round(l_discount * 100) as int) % 7 when 0 then 'AIR' when 1 then 'MAIL' when 2 then 'RAIL' when 3 then 'SHIP' when 4 then 'TRUCK' when 5 then 'FOB' else 'REG' end as l_shipmode"
#: A line sets one variable of its order, by the kind of variable to text from its own columns.
_VALUE = """case when k = 0 then case l_shipmode when 'AIR' then ' MAX ' when 'MAIL' then 'off' when 'RAIL' then '' when 'SHIP' then '   ' when 'TRUCK' then 'mixed' when 'FOB' then 'warp' else 'Balanced' end
  when k = 1 then case l_returnflag when 'R' then 'yes' when 'A' then '' else '0' end
  when k < 13 then case l_returnflag when 'R' then '  ' else ' ' || lower(l_shipmode) || ' ' end
  when k < 16 then case when l_shipmode = 'FOB' then '12x' when l_returnflag = 'R' then ' ' else ' ' || cast(cast(l_quantity as int) as {0}) || ' ' end
  else case l_shipmode when 'AIR' then ' TRUE ' when 'RAIL' then 'on' when 'FOB' then '' else 'no' end end"""
_GIVEN = {"mode": "config", "model": "base", "device": "cuda", **dict.fromkeys(O.PRECISION, "auto"), **dict.fromkeys(O.INTEGERS, 2048), **dict.fromkeys(O.BOOLEANS, True)}


def _sql() -> str:
    last = ", ".join(f"(max(struct_pack(o := o, v := v)) filter (where k = {i})).v as v{i}" for i in range(len(_KEYS)))
    string = {f: f"nullif(trim(v{2 + i}), '')" for i, f in enumerate(O.STRINGS)}
    number = {f: f"nullif(trim(v{13 + i}), '')" for i, f in enumerate(O.INTEGERS)}
    boolean = {f: f"v{16 + i}" for i, f in enumerate(O.BOOLEANS)}
    custom = f"coalesce({', '.join(string[f] for f in O.PRECISION)}) is not null"
    broken = " ".join(f"when {v} is not null and try_cast({v} as int) is null then '{f} is no number: ' || {v}" for f, v in number.items())
    texts = ", ".join(f"coalesce({string[f]}, " + (f"m.p[{O.PRECISION.index(f) + 1}], " if f in O.PRECISION else "") + f"'{_GIVEN[f]}')" for f in O.STRINGS)
    others = ", ".join([*(f"coalesce(try_cast({v} as int), 2048)::varchar" for v in number.values()), *(f"case when {v} is null then 'true' when lower(trim({v})) in ('1', 'true', 'yes', 'on') then 'true' else 'false' end" for v in boolean.values())])
    modes = ", ".join(f"('{m}', {p})" for m, p in O.MODES.items())
    return f"""
with l as (select l_orderkey, (l_partkey % {len(_KEYS)})::int as k, l_linenumber * 100000000 + l_partkey * 10 + l_suppkey % 10 as o, l_returnflag, l_quantity, {_SHIP} from lineitem),
e as (select l_orderkey, {last} from (select l_orderkey, k, o, {_VALUE.format('varchar')} as v from l) group by 1),
n(name, mode) as (values {sql_rows(list(O.MODE_NAMES.items()))}), p(mode, p) as (values {modes}),
a as (select *, case when coalesce(v0, '') <> '' then nullif(lower(trim(v0)), '') when lower(trim(v1)) in ('1', 'true', 'yes', 'on') then 'optimized' when v1 is not null then 'bf16' end as asked from e),
s as (select a.*, n.mode as known, m.p, case when asked is not null and n.mode is null then 'unknown mode ' || asked {broken} end as error from a left join n on n.name = a.asked left join p m on m.mode = n.mode)
select l_orderkey, case when error is null then case when {custom} then 'custom' else coalesce(known, 'config') end end as mode, case when error is null then concat_ws('/', {texts}) end as texts,
  case when error is null then concat_ws('/', {others}) end as others, error from s m"""


@R.query(_sql())
def runtime_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings after each order's environment, of which each line sets a variable and the last one counts."""
    k = (F.col("l_partkey") % len(_KEYS)).cast("int")
    lines = read(spark, sf_dir, "lineitem").selectExpr("*", _SHIP).withColumn("k", k).select("l_orderkey", "k", F.expr("l_linenumber * 100000000L + l_partkey * 10 + l_suppkey % 10").alias("o"), F.expr(_VALUE.format("string")).alias("v"))
    last = lines.groupBy("l_orderkey", "k").agg(F.max(F.struct("o", "v"))["v"].alias("v")).select("l_orderkey", F.get(F.array(*map(F.lit, _KEYS)), F.col("k")).alias("name"), "v")
    env = last.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("env"))
    given = F.struct(*(F.lit(v).alias(f) for f, v in _GIVEN.items()))
    rows = env.select("l_orderkey", O.runtime_settings(F.col("env"), given).alias("s"))
    joined = lambda names: F.when(F.col("s.error").isNull(), F.concat_ws("/", *(F.col(f"s.{f}").cast("string") for f in names)))
    return rows.select("l_orderkey", "s.mode", joined(O.STRINGS).alias("texts"), joined([*O.INTEGERS, *O.BOOLEANS]).alias("others"), "s.error")


#: Spans: customers, whose language and main language come from their nation; labels: segments of the market and codes.
_CODES = "['en', 'de', 'und', 'zh-cn', 'gl', 'mn', 'xx', '', 'fr', 'jv', 'yue', 'EN-GB', 'cmn']"
_SPAN = "case when c_mktsegment = 'BUILDING' then null else {0}[1 + c_nationkey % 13] end as language, case c_mktsegment when 'MACHINERY' then 'fr' when 'FURNITURE' then '' when 'HOUSEHOLD' then 'qq' else 'es' end as main"
_LABEL = "case when n_regionkey = 0 then 'es' when n_regionkey = 1 then 'cmn-latn-pinyin' when n_regionkey = 2 then 'it' when n_regionkey = 3 then 'id' else 'ru' end"
_VOICE = "case when coalesce({0}, '') = '' then 'en-us' when b = 'yue' or l in ('zh-hk', 'zh-yue') then 'yue' when b in ('zh', 'cmn') then 'cmn-latn-pinyin' when b in ('jv', 'su') then 'id' when b = 'gl' then 'es' when b = 'mn' then 'ru' when {0} = 'en' then 'en-us' else b end"


@R.query(f"""
with s as (select label, min(n_nationkey)::bigint as id from (select {_LABEL} as label, n_nationkey from nation) group by 1), m(base, label) as (values ('it', 'nobody'), ('fr', 'it'), ('xx', 'ru')),
c as (select c_custkey, {_SPAN.format(_CODES)} from customer),
q as (select c_custkey, unnest([1, 2, 3]) as step, unnest([lower(coalesce(nullif(nullif(language, 'und'), ''), nullif(main, ''), 'en')), nullif(main, ''), 'en']) as asked from c),
v as (select *, lower(replace(trim(asked), '_', '-')) as l, string_split(lower(replace(trim(asked), '_', '-')), '-')[1] as b from q where asked is not null),
w as (select *, {_VOICE.format('asked')} as voice from v), x as (select *, case when starts_with(voice, 'en') then 'en' else voice end as base from w),
t as (select x.c_custkey, x.step, 0 as prio, m.label, voice from x join m using (base)
  union all select c_custkey, step, i, list_extract(case when base = 'cmn' or starts_with(base, 'cmn-latn') then ['zh', 'cmn-latn-pinyin'] when base = 'en' then ['en', 'en-us', 'en-gb'] else [base] end, i::int), voice from x, (select unnest(range(1, 4)) as i)),
f as (select t.*, s.id, row_number() over (partition by c_custkey order by step, prio) as k from t join s using (label))
select c.c_custkey, coalesce(f.label, d.label) as speaker, coalesce(f.id, 0) as speaker_id, coalesce(f.voice, d.label) as voice, coalesce(f.step, 4)::int as step
from c left join f on f.c_custkey = c.c_custkey and f.k = 1 cross join (select label from s order by id limit 1) d""")
def speaker_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speaker of each span: by its language, the main language, the primary one, or the first there is."""
    known = read(spark, sf_dir, "nation").groupBy(F.expr(_LABEL).alias("label")).agg(F.min("n_nationkey").cast("long").alias("speaker_id")).withColumn("place", F.col("speaker_id"))
    mapped = spark.createDataFrame([("it", "nobody"), ("fr", "it"), ("xx", "ru")], "base string, label string")
    language, main = _SPAN.format(_CODES.replace("[", "array(", 1).replace("]", ")")).replace("[1 + c_nationkey % 13]", "[c_nationkey % 13]").split(" as language, ")
    spans = read(spark, sf_dir, "customer").selectExpr("c_custkey", f"{language} as language", main)
    return O.speakers_with_fallbacks(spans, known, mapped).select("c_custkey", "speaker", "speaker_id", "voice", "step")


QUERIES, ORACLE_SQL = R.queries, R.sql
