"""Queries over text: normalisation, locales, scripts, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sonoglyph.dims import INCOMPLETE_ENDINGS, LANGUAGES, LONG_CODES, PUNCTUATION
from sonoglyph.functions import text as X
from sonoglyph.plans.registry import Registry, read, sql_rows, sql_string

R = Registry()


def _replaces(text: str) -> str:
    for k, v in PUNCTUATION.items():
        text = f"replace({text}, {sql_string(k)}, {sql_string(v)})"
    return text


@R.query(f"select doc_id, md5({_replaces("translate(text, '.,;!?-', '。，；！？—')")}) as normalized from documents")
def norm_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.translate("text", ".,;!?-", "。，；！？—")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalize_punctuation(wide)).alias("normalized"))


_CODES = "case doc_id % 7 when 0 then lang when 1 then lang || '-us' when 2 then upper(lang) || '_gb' when 3 then ' ' || lang || '--latn-x ' when 4 then 'und' when 5 then '' else 'zh-hk' end"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(_CODES).alias("code"))


@R.query(f"""
with c as (select doc_id, {_CODES} as code from documents),
p as (select doc_id, code, string_split(lower(code), '-') as lp, list_filter(string_split(replace(trim(code), '_', '-'), '-'), lambda x: x <> '') as cp from c)
select doc_id, case when len(lp) = 2 then lp[1] || '-' || upper(lp[2]) else lp[1] end as normalized,
  coalesce(nullif(array_to_string(list_transform(cp, lambda x, i: case i when 1 then lower(x) when 2 then upper(x) else x end), '-'), ''), '') as canonical,
  string_split(replace(lower(trim(code)), '_', '-'), '-')[1] as base from p""")
def locale_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("code")
    return _codes(spark, sf_dir).select("doc_id", X.normalize_locale(code).alias("normalized"), X.canonical_locale(code).alias("canonical"), X.locale_base(code).alias("base"))


_NAMES = [(k, v.lower()) for k, v in LANGUAGES.items()] + [(k, LANGUAGES[v].lower()) for k, v in LONG_CODES.items()]
_NAMES += [(v, v) for v in sorted({v for _, v in _NAMES} | {"auto", "default", "multilingual"})]


@R.query(f"""
with n(k, name) as (values {sql_rows(_NAMES)}),
c as (select doc_id, code, replace(lower(trim(code)), '_', '-') as key from (select doc_id, {_CODES} as code from documents))
select doc_id, case when code = '' then 'default' else coalesce(a.name, b.name, key) end as language_key
from c left join n a on a.k = key left join n b on b.k = string_split(key, '-')[1]""")
def language_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("doc_id", X.language_key(F.col("code")).alias("language_key"))


@R.query(f"""
with c as (select doc_id, code, replace(lower(trim(code)), '_', '-') as key from (select doc_id, {_CODES} as code from documents)),
b as (select *, string_split(key, '-')[1] as base from c)
select doc_id, case when code = '' then 'en-us' when base = 'yue' or key in ('zh-hk', 'zh-yue') then 'yue' when base in ('zh', 'cmn') then 'cmn-latn-pinyin'
  when base in ('jv', 'su') then 'id' when base = 'gl' then 'es' when base = 'mn' then 'ru' when code = 'en' then 'en-us' else base end as voice from b""")
def voice_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("doc_id", X.voice_of(F.col("code")).alias("voice"))


@R.query(f"""
select doc_id, lower(coalesce(nullif(nullif({_CODES}, 'und'), ''), nullif(lang, ''), 'en')) as language from documents""")
def effective_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("doc_id", X.effective_language(F.col("code"), F.col("lang")).alias("language"))


@R.query(r"select doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) as weight from documents")
def lang_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.language_weight(F.col("text")).cast("long").alias("weight"))


_MIXED = "case doc_id % 8 when 6 then translate(text, 'm', 'ᠮ') when 7 then translate(text, 'aei', 'ᎠᎡཀ') when 0 then text when 1 then translate(text, 'aeo', 'аео') when 2 then translate(text, 'th', '漢字') when 3 then translate(text, 'thr', '漢字か') when 4 then translate(text, 'n', '한') else '' end"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(_MIXED).alias("text"))


@R.query(rf"""
with d as (select doc_id, {_MIXED} as text from documents)
select doc_id, not regexp_matches(text, '[^\p{{Latin}}\p{{Common}}\p{{Inherited}}]') as latin_only,
  regexp_matches(text, '\p{{Han}}') and not regexp_matches(text, '[\p{{Hiragana}}\p{{Katakana}}]') as han_no_kana,
  case when regexp_matches(text, '\p{{Han}}') and regexp_matches(text, '[\p{{Hiragana}}\p{{Katakana}}]') then 'ja' when regexp_matches(text, '\p{{Han}}') then 'zh'
    when regexp_matches(text, '\p{{Hangul}}') then 'ko' when regexp_matches(text, '\p{{Cyrillic}}') then 'ru' when regexp_matches(text, '\p{{Latin}}') then 'en' else 'und' end as by_script
from d""")
def detect_by_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _mixed(spark, sf_dir).select("doc_id", X.is_latin_only(t).alias("latin_only"), X.has_han_without_kana(t).alias("han_no_kana"), X.language_by_script(t).alias("by_script"))


_ENDINGS = ", ".join(f"'{w}'" for w in INCOMPLETE_ENDINGS)


@R.query(rf"""
with f as (select conv_id, turn, trim(regexp_replace(text || case when turn % 2 = 0 then ' and' else '' end, '\s+', ' ', 'g')) as t from conversations),
w as (select *, lower(list_extract(regexp_extract_all(t, '[A-Za-z'']+'), -1)) as last, len(regexp_extract_all(t, '[.!?。！？]')) as ends from f)
select conv_id, turn, case when last in ({_ENDINGS}) and ends >= 2 then trim(regexp_extract(t, '^(?s)(.*[.!?。！？])[^.!?。！？]*[.!?。！？][^.!?。！？]*$', 1))
  when last in ({_ENDINGS}) and regexp_extract(t, '^(?s)(.+)[,，、][^,，、]*$', 1) <> '' then trim(regexp_extract(t, '^(?s)(.+)[,，、][^,，、]*$', 1)) else t end as prompt from w""")
def sanitize_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("text || case when turn % 2 = 0 then ' and' else '' end")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.sanitize_prompt(said).alias("prompt"))


_TIMES = "case event_id % 6 when 0 then cast(cast(value as bigint) as string) || 'ms' when 1 then cast(cast(value as bigint) as string) || '.5s' when 2 then ' ' || cast(cast(value as bigint) as string) || ' ' when 3 then 'fast' when 4 then '1.25S' else '' end"


@R.query(r"""
with e as (select event_id, lower(trim(case event_id % 6 when 0 then cast(cast(trunc(value) as bigint) as varchar) || 'ms' when 1 then cast(cast(trunc(value) as bigint) as varchar) || '.5s'
  when 2 then ' ' || cast(cast(trunc(value) as bigint) as varchar) || ' ' when 3 then 'fast' when 4 then '1.25S' else '' end)) as t from events)
select event_id, case when regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)ms') then cast(trunc(cast(t[:-3] as double)) as int)
  when regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)s') then cast(trunc(cast(t[:-2] as double) * 1000) as int)
  when regexp_full_match(t, '[+-]?(\d+\.?\d*|\.\d+)') then cast(trunc(cast(t as double)) as int) end as duration_ms from e""")
def xml_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", X.milliseconds(F.expr(_TIMES)).alias("duration_ms"))


@R.query(r"select doc_id, md5(regexp_replace(replace(replace(text, ' the ', ' (en) '), '.', '(fr'), '\([^)]*(\)|$)', '', 'g')) as phonemes from documents")
def no_language_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = F.expr("replace(replace(text, ' the ', ' (en) '), '.', '(fr')")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.without_flags(flagged)).alias("phonemes"))


@R.query("""
select doc_id, length(text) as n_chars, octet_length(encode(text)) as n_bytes from documents where length(text) <= 1000 and octet_length(encode(text)) <= 10485760""")
def max_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("length(text) <= 1000 and octet_length(text) <= 10485760")
    return docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"))


@R.query("""
with r as (select conv_id, turn, case when turn % 3 = 0 then null else text end as text, case when turn % 2 = 0 then '<speak>' || text || '</speak>' else '' end as ssml from conversations)
select conv_id, turn, (coalesce(text, '') <> '') <> (coalesce(ssml, '') <> '') as valid from r""")
def exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "case when turn % 3 = 0 then null else text end as text", "case when turn % 2 = 0 then '<speak>' || text || '</speak>' else '' end as ssml")
    return rows.selectExpr("conv_id", "turn", "(coalesce(text, '') <> '') <> (coalesce(ssml, '') <> '') as valid")


@R.query("select user_id, event_id, coalesce(lower(trim(case event_id % 4 when 0 then ' Yes ' when 1 then 'off' when 2 then 'ON' end)) in ('1', 'true', 'yes', 'on'), true) as enabled from events")
def env_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr("case event_id % 4 when 0 then ' Yes ' when 1 then 'off' when 2 then 'ON' end")
    return read(spark, sf_dir, "events").select("user_id", "event_id", X.is_enabled(given, True).alias("enabled"))


@R.query("select page_id, substr(sha256(url), 1, 16) as cache_dir, substr(sha256(url), 1, 12) as log_key, sha1(html) as content_sha1 from pages")
def hash_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.left(F.sha2("url", 256), F.lit(16)).alias("cache_dir"), F.left(F.sha2("url", 256), F.lit(12)).alias("log_key"), F.sha1("html").alias("content_sha1"))


@R.query("select doc_id, case when length(text) > 50 then substr(text, 1, 50) || '...' else text end as preview, case when length(source) > 24 then substr(source, 1, 24) || '...' else source end as label, case when length(text) > 80 then substr(text, 1, 80) || '...' else text end as line from documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and labels cut to the lengths that messages, lists and lines of a log show."""
    return read(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"), X.preview(F.col("source"), 24).alias("label"), X.preview(F.col("text"), 80).alias("line"))


@R.query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, count(*) as n_segments from l where length(regexp_replace(line, '\\s+', '', 'g')) > 0 group by doc_id""")
def blank_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.length(X.strip(F.col("line"))) > 0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_segments"))


@R.query("""
with a as (select c_custkey, 'Basic ' || base64(encode(c_name || ':' || c_mktsegment || ':x')) as header from customer),
d as (select c_custkey, decode(from_base64(substr(header, 7))) as pair from a where starts_with(header, 'Basic '))
select c_custkey, string_split(pair, ':')[1] as username, substr(pair, strpos(pair, ':') + 1) as password from d""")
def basic_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Basic "), F.base64(F.concat("c_name", F.lit(":"), "c_mktsegment", F.lit(":x")).cast("binary"))).alias("header"))
    pair = F.split(F.decode(F.unbase64(F.expr("substring(header, 7)")), "UTF-8"), ":", 2)
    return sent.where(F.startswith("header", F.lit("Basic "))).select("c_custkey", pair[0].alias("username"), pair[1].alias("password"))


QUERIES, ORACLE_SQL = R.queries, R.sql
