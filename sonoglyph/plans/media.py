"""Queries that need Python in a vectorised function: files of samples, markup, normal forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoglyph.functions import audio as A, diacritics as D
from sonoglyph.functions.markup import folded_code_points, ssml_rows, ssml_segments
from sonoglyph.plans.registry import Registry, read
from sonoglyph.sources.wav import build_wav, parse_wav

R = Registry()


@R.query("select vec_id, len(embedding) as n_samples, 22050 as sample_rate, 16 as bit_depth, true as same, 44 + 2 * len(embedding) as n_bytes from embeddings")
def wav_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 16-bit files and back."""
    samples = read(spark, sf_dir, "embeddings").select("vec_id", A.to_int16(F.transform("embedding", lambda x: x.cast("double"))).alias("s"))
    made = samples.withColumn("file", build_wav("s", F.lit(22_050)))
    back = made.select("vec_id", "s", F.length("file").alias("n_bytes"), parse_wav("file").alias("w"))
    return back.select("vec_id", F.size("w.samples").cast("long").alias("n_samples"), "w.sample_rate", "w.bit_depth", (F.transform("w.samples", lambda x: x.cast("smallint")) == F.col("s")).alias("same"), "n_bytes")


@R.query("""
with t as (select conv_id, turn, regexp_replace(text, '[<>&]', ' ', 'g') as t from conversations),
m as (select conv_id, turn, '<speak>' || t || '<break time="0.5s"/>' || case when turn % 2 = 0 then '<voice name="x">' || t || '</voice>' else '' end || case when turn % 4 = 3 then '' else '</speak>' end as m from t)
select conv_id, turn, case when ends_with(m, '</speak>') then len(list_filter(regexp_split_to_array(m, '<[^>]*>'), lambda x: trim(x) <> '')) + len(regexp_extract_all(m, '<break')) else 0 end as n_segments, not ends_with(m, '</speak>') as failed from m""")
def ssml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup made of turns: a text, a break, and on even turns a text of another voice; every fourth is not closed."""
    text = F.regexp_replace("text", "[<>&]", " ")
    made = F.concat(F.lit("<speak>"), text, F.lit('<break time="0.5s"/>'), F.when(F.col("turn") % 2 == 0, F.concat(F.lit('<voice name="x">'), text, F.lit("</voice>"))).otherwise(""), F.when(F.col("turn") % 4 == 3, "").otherwise("</speak>"))
    parsed = read(spark, sf_dir, "conversations").select("conv_id", "turn", ssml_segments(made).alias("s"))
    return parsed.select("conv_id", "turn", F.coalesce(F.size("s.segments"), F.lit(0)).cast("long").alias("n_segments"), F.col("s.error").isNotNull().alias("failed"))


@R.query(r"""
with t as (select conv_id, turn, role, regexp_replace(regexp_replace(text, '[<>&]', ' ', 'g'), '^\s+|\s+$', '', 'g') as t from conversations),
p as (select conv_id, turn, unnest([
    {'type': 'text', 'segment': case when turn % 3 = 0 then t || ' ' || t else t end, 'speaker': null, 'duration_ms': null},
    {'type': 'break', 'segment': null, 'speaker': null, 'duration_ms': length(t)},
    {'type': 'text', 'segment': t, 'speaker': role, 'duration_ms': null}]) as s, unnest([1, 2, 3]) as k from t where turn % 4 <> 3),
k as (select conv_id, turn, s.type as type, s.segment as segment, s.speaker as speaker, s.duration_ms::int as duration_ms, k from p where s.type = 'break' or s.segment <> '')
select conv_id, turn, (row_number() over (partition by conv_id, turn order by k) - 1)::int as seq, type, segment, speaker, duration_ms, false as failed from k
union all select conv_id, turn, null, null, null, null, null, true from t where turn % 4 = 3""")
def ssml_segments_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup made of turns as rows: on every third turn a text in two parts of no voice, a break as long as the text, and the text in the role's voice; every fourth turn is not closed."""
    text = F.regexp_replace(F.regexp_replace("text", "[<>&]", " "), r"^\s+|\s+$", "")
    parts = F.when(F.col("turn") % 3 == 0, F.concat(text, F.lit("<voice>"), text, F.lit("</voice>"))).otherwise(text)
    made = F.concat(F.lit("<speak>"), parts, F.lit('<break time="'), F.length(text).cast("string"), F.lit('"/><voice name="'), "role", F.lit('">'), text, F.lit("</voice>"), F.when(F.col("turn") % 4 == 3, "").otherwise("</speak>"))
    rows = ssml_rows(read(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("m")), "m")
    return rows.select("conv_id", "turn", "seq", "type", "segment", "speaker", "duration_ms", F.col("error").isNotNull().alias("failed"))


@R.query()
def nfd_code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = read(spark, sf_dir, "documents").select("doc_id", folded_code_points("text").alias("p"))
    return points.select("doc_id", F.size("p").alias("n_points"), F.size(F.filter("p", lambda c: c.rlike(r"\p{M}"))).alias("n_marks"))


_FORM = "case label " + " ".join(f"when {k} then '{v}'" for k, v in D.FORMS.items() if k not in D.NO_MARK) + " else '' end"


@R.query(rf"""
with t as (select conv_id, turn, regexp_replace(replace(replace(text, 'e', 'e{D.MARKS[2]}'), 'th', 'th{D.MARKS[5]}{D.MARKS[0]}'), '\s', ' ', 'g') as m from conversations),
s as (select *, regexp_replace(m, '[{D.MARKS}]', '', 'g') as s from t),
c as (select conv_id, turn, m, s, unnest(string_split(s, '')) as c, unnest(range(length(s))) as i from s where s <> ''),
l as (select *, case when i < 315 then (ascii(c) + i) % 29 end as label, case when c >= 'a' and c <= 'z' and length(c) = 1 and ascii(c) < 123 then ascii(c) - 95 else 1 end as id from c),
r as (select conv_id, turn, string_agg(c || {_FORM}, '' order by i) as restored, sum((i + 1) * id) filter (where i < 315) as ids, least(count(*), 315) as n from l group by all),
k as (select conv_id, turn, sum(j * (j + 1)) as places from (select conv_id, turn, unnest(string_split(m, '')) as c, unnest(range(length(m))) as j from t where m <> '') where not regexp_matches(c, '[{D.MARKS}]') group by all)
select s.conv_id, s.turn, s.s as stripped, md5(coalesce(restored, '')) as restored_md5, coalesce(ids, 0)::bigint as ids, coalesce(places, 0)::bigint as places from s left join r using (conv_id, turn) left join k using (conv_id, turn)""")
def diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks stripped with their places, characters encoded for a model, and its labels, here made from the characters, inserted."""
    marked = F.regexp_replace(F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("e" + D.MARKS[2])), F.lit("th"), F.lit("th" + D.MARKS[5] + D.MARKS[0])), r"\s", " ")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", marked.alias("m")).withColumn("s", D.without_marks(F.col("m")))
    letters = F.create_map(*(F.lit(x) for c in range(97, 123) for x in (chr(c), c - 95)))
    labels = F.transform(F.slice(D.characters(F.col("s")), 1, D.MOST), lambda c, i: (F.ascii(c) + i) % 29)
    total = lambda x, f: F.aggregate(F.transform(x, f), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select("conv_id", "turn", F.col("s").alias("stripped"), F.md5(D.with_marks(F.col("s"), labels)).alias("restored_md5"),
                       total(D.encoded(F.col("s"), letters), lambda v, i: (v * (i + 1)).cast("long")).alias("ids"), total(D.kept_places(F.col("m")), lambda j: (j * (j + 1)).cast("long")).alias("places"))


QUERIES, ORACLE_SQL = R.queries, R.sql
