"""Queries over language detection: settling characters, labels, bias, the splitter, names and codes. The labels of a
detector are columns: here they are made from the table's own language and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sonoglyph.dims import BANNED_LATIN, COMMON_LATIN, CONFUSABLE, LANGUAGES, LOCALES, MARKERS, SCRIPT_LANGUAGES, SCRIPT_THRESHOLDS, SCRIPTS
from sonoglyph.functions import text as X
from sonoglyph.operators import detect as D
from sonoglyph.plans.registry import Registry, read

R = Registry()
_MIXED = "case doc_id % 10 when 0 then text when 1 then translate(text, 'aeo', 'аеї') when 2 then translate(text, 'th', '漢字') when 3 then translate(text, 'thr', '漢字か') when 4 then translate(text, 'n', '한') when 5 then translate(text, 'eo', 'सम') when 6 then translate(text, 'xk', '円円') when 7 then translate(text, 'aei', 'ᠠᎡཀ') when 8 then '12 + 3!' else '' end"
_LABEL = "case doc_id % 9 when 0 then 'und' when 1 then 'ja' when 2 then 'wo' when 3 then 'ru' when 4 then 'zz' else lang end"
_RELIABLE = "doc_id % 4 <> 0"


def _codes(codes: list[str]) -> str:
    return ", ".join(f"'{c}'" for c in codes)


def _class(scripts: list[str], letters: str = "") -> str:
    return "[" + "".join(rf"\p{{{s}}}" for s in scripts) + letters + "]"


def _marker_sql(t: str) -> str:
    return "case " + " ".join(f"when regexp_matches({t}, '{_class(scripts, letters)}') then '{code}'" for code, scripts, letters in MARKERS) + " end"


def _script_sql(t: str) -> str:
    has = lambda s: f"regexp_matches({t}, '{_class([s])}')"
    rest = [("Hangul", "ko"), ("Thai", "th"), ("Devanagari", "hi"), ("Arabic", "ar"), ("Hebrew", "he"), ("Greek", "el"), ("Cyrillic", "ru"), ("Tamil", "ta"), ("Telugu", "te"), ("Bengali", "bn"), ("Latin", "en")]
    kana = f"regexp_matches({t}, '{_class(['Hiragana', 'Katakana'])}')"
    return f"case when {has('Han')} and {kana} then 'ja' when {has('Han')} then 'zh' " + " ".join(f"when {has(s)} then '{c}'" for s, c in rest) + " else 'und' end"


_LATIN_ONLY = r"not regexp_matches({0}, '[^\p{{Latin}}\p{{Common}}\p{{Inherited}}]')"
_HAN_ONLY = r"(regexp_matches({0}, '\p{{Han}}') and not regexp_matches({0}, '[\p{{Hiragana}}\p{{Katakana}}]'))"


def _main_sql(t: str, label: str, reliable: str) -> str:
    latin = _LATIN_ONLY.format(t)
    return (
        f"coalesce({_marker_sql(t)}, case when {label} = 'und' then {_script_sql(t)} when {label} = 'ja' and {_HAN_ONLY.format(t)} then 'zh' when {label} in ({_codes(BANNED_LATIN)}) then {_script_sql(t)} "
        f"when {label} not in ({_codes(COMMON_LATIN)}) and {latin} then {_script_sql(t)} when not ({reliable}) and {latin} then 'en' else {label} end)")


def _valid_sql(script: str, lang: str) -> str:
    shared = " ".join(f"when {script} = '{s}' then {lang} in ({_codes(c)})" for s, c in SCRIPT_LANGUAGES.items())
    own = " ".join(f"when {script} = '{s}' then {lang} = '{code}'" for code, scripts, _ in MARKERS for s in scripts)
    return f"case when {script} in ('Common', 'Inherited', 'Unknown') then true {shared} {own} else false end"


def _threshold_sql(script: str, main: str, label: str, i: int) -> str:
    pairs = [(f"{main} in ({_codes(c)}) and {label} in ({_codes(c)})", p[i]) for c, p in CONFUSABLE]
    pairs += [(f"{script} = '{s}' and {main} in ({_codes(c)}) and {label} in ({_codes(c)})", SCRIPT_THRESHOLDS[s][i]) for s, c in SCRIPT_LANGUAGES.items()]
    return "case " + " ".join(f"when {w} then {v}::double" for w, v in pairs) + f" else {(0.7, 0.1)[i]}::double end"


def _bias_sql(t: str, main: str, script: str, label: str, p: str, q: str) -> str:
    least, most = (_threshold_sql(script, main, label, i) for i in (0, 1))
    return (
        f"case when {script} = 'Han' and {main} not in ('zh', 'ja') then case when {_HAN_ONLY.format(t)} then 'zh' else 'ja' end when {label} in ({_codes(BANNED_LATIN)}) or {label} = {main} then {main} "
        f"when {least} > 0.9 then case when {p} > {least} and {q} < {most} then {label} else {main} end else {label} end")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(_MIXED).alias("text"), F.expr(_LABEL).alias("label"), F.expr(_RELIABLE).alias("reliable"))


_DOCS = f"d as (select doc_id, lang, {_MIXED} as text, {_LABEL} as label, {_RELIABLE} as reliable from documents)"
_NAMES = " ".join(rf"when regexp_matches(c, '^{_class([s])}') then '{s}'" for s in SCRIPTS)


@R.query(rf"""
with {_DOCS}, c as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[^\p{{Common}}\p{{Inherited}}]'))) as c from d),
s as (select doc_id, list_sort(list_distinct(list(case {_NAMES} else 'Unknown' end))) as s from c group by doc_id)
select d.doc_id, {_marker_sql('d.text')} as marked, array_to_string(list_filter(coalesce(s, []), lambda x: x <> 'Unknown'), ',') as scripts from d left join s using (doc_id)""")
def language_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that a text's characters settle, and the scripts that it has."""
    return _texts(spark, sf_dir).select("doc_id", D.marker_language(F.col("text")).alias("marked"), F.array_join(D.script_set(F.col("text")), ",").alias("scripts"))


@R.query(f"with {_DOCS} select doc_id, {_main_sql('text', 'label', 'reliable')} as language from d")
def detect_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", D.main_language(F.col("text"), F.col("label"), F.col("reliable")).alias("language"))


_SPAN_COLUMNS = [
    "doc_id", "case doc_id % 5 when 0 then 'Latin' when 1 then 'Han' when 2 then 'Cyrillic' when 3 then 'Thai' else 'Common' end as script",
    "case doc_id % 7 when 0 then 'sv' when 1 then 'pt' when 2 then 'wo' when 3 then 'no' when 4 then 'zh' when 5 then 'uk' else lang end as label",
    "cast((doc_id % 101) / 100.0 as double) as p", "cast((doc_id % 13) / 100.0 as double) as q", "case when doc_id % 2 = 0 then '山' else 'a' end as text",
    "case doc_id % 11 when 0 then 'no' when 1 then 'da' when 2 then 'th' when 3 then 'ru' when 4 then 'ja' else lang end as main",
]
_SPANS = f"select {', '.join(_SPAN_COLUMNS)} from documents"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(*_SPAN_COLUMNS)


@R.query(f"with s as ({_SPANS}) select doc_id, {_bias_sql('text', 'main', 'script', 'label', 'p', 'q')} as language from s")
def detect_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.struct(F.col("label").alias("language"), F.col("p").alias("probability"), F.col("q").alias("main_probability"))
    return _spans(spark, sf_dir).select("doc_id", D.biased_language(F.col("text"), F.col("main"), F.col("script"), said).alias("language"))


@R.query(f"""with s as ({_SPANS}) select doc_id, {_valid_sql('script', 'main')} as valid, label in ({_codes(COMMON_LATIN)}) as common, label in ({_codes(BANNED_LATIN)}) as banned from s""")
def script_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a script can be the language's; whether a label is a trusted or a distrusted one."""
    return _spans(spark, sf_dir).select("doc_id", D.script_valid(F.col("script"), F.col("main")).alias("valid"), F.col("label").isin(*COMMON_LATIN).alias("common"), F.col("label").isin(*BANNED_LATIN).alias("banned"))


@R.query("""
with x as (select doc_id, [{'l': case when doc_id % 3 = 0 then 'un' else lang end, 'p': 0.5::double}, {'l': case when doc_id % 2 = 0 then 'zh-Hant' else 'tlh' end, 'p': 0.3::double}, {'l': 'en', 'p': 0.1::double}] as d from documents),
k as (select doc_id, list_filter(list_transform(list_filter(d[1:2], lambda x: x.l <> 'un'), lambda x: {'l': case when starts_with(x.l, 'zh') then 'zh' else x.l end, 'p': x.p}), lambda x: x.l in ('en', 'de', 'fr', 'zh')) as k from x)
select doc_id, case when len(k) > 0 then array_to_string(list_transform(k, lambda x: x.l), ',') else 'und' end as languages, case when len(k) > 0 then k[1].p else 1.0 end as probability from k""")
def allowed_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two of a detector's answers, those of allowed languages."""
    answers = F.expr("array(struct(case when doc_id % 3 = 0 then 'un' else lang end as language, 0.5D as probability), struct(case when doc_id % 2 = 0 then 'zh-Hant' else 'tlh' end as language, 0.3D as probability), struct('en' as language, 0.1D as probability))")
    kept = read(spark, sf_dir, "documents").select("doc_id", D.allowed(answers, ["en", "de", "fr", "zh"], 2).alias("k"))
    return kept.select("doc_id", F.array_join(F.transform("k", lambda d: d["language"]), ",").alias("languages"), F.get("k", 0)["probability"].alias("probability"))


#: What the detector says of a token or run: it is unsure of short ones, takes some for another language and some for one of no use.
_SAID = {"language": "case when length({0}) % 7 = 6 then 'es' when length({0}) % 11 = 10 then 'wo' when length({0}) < 3 then 'und' else {1} end", "reliable": "length({0}) > 4"}


def _said(run: Column, main: Column) -> Column:
    n = F.length(run)
    language = F.when(n % 7 == 6, "es").when(n % 11 == 10, "wo").when(n < 3, "und").otherwise(main)
    return F.struct(language.alias("language"), F.lit(0.9).alias("probability"), F.lit(0.05).alias("main_probability"), (n > 4).alias("reliable"))


def _tokens(run: Column, main: Column) -> Column:
    """Up to six characters but e, which belongs to no token."""
    return F.regexp_extract_all(run, F.lit("[^e]{1,6}"), F.lit(0))


_RUNS = "(?s)" + "|".join(rf"\p{{{s}}}+" for s in ["Latin", "Common", "Inherited", *SCRIPTS[1:]]) + "|.+?"
_SCRIPT = "case " + " ".join(rf"when regexp_matches(run, '^\p{{{s}}}') then '{s}'" for s in ["Latin", "Common", "Inherited", *SCRIPTS[1:]]) + " else 'Unknown' end"


def _split_sql(pieces: str) -> str:
    """``pieces`` (doc_id, seq, k, piece, script, first, last) are the parts of runs in order, ``first`` and ``last`` their languages."""
    order = "partition by doc_id order by seq, k"
    return f"""{pieces},
f as (select *, coalesce(last_value(nullif(language, 'und') ignore nulls) over ({order} rows between unbounded preceding and current row),
        first_value(nullif(language, 'und') ignore nulls) over ({order} rows between current row and unbounded following), 'und') as filled,
        coalesce(sum(length(piece)) over ({order} rows between unbounded preceding and 1 preceding), 0)::bigint as start from l),
c as (select *, case when lag(filled) over ({order}) is not distinct from filled and row_number() over ({order}) > 1 then 0 else 1 end as change from f),
i as (select *, sum(change) over ({order} rows between unbounded preceding and current row) as island from c)
select doc_id, island::bigint as seq, filled as language, md5(string_agg(piece, '' order by seq, k)) as text_md5, min(start) as start, max(start + length(piece)) as "end" from i group by doc_id, island, filled"""


def _judged(t: str) -> str:
    return _bias_sql(t, "main", "script", _SAID["language"].format(t, "main"), "0.9", "0.05")


_SPLIT = f"""
with {_DOCS}, m as (select doc_id, text, {_main_sql('text', 'label', 'reliable')} as main from d),
r as (select doc_id, main, unnest(regexp_extract_all(text, '{_RUNS}')) as run, unnest(range(len(regexp_extract_all(text, '{_RUNS}')))) as seq from m),
x as (select *, {_SCRIPT} as script from r),
w as (select *, script in ('Common', 'Inherited') or trim(run) = '' as blank, {_valid_sql('script', 'main')} as valid from x),
o as (select doc_id, seq, script, run, main, case when blank then 'und' when script = 'Han' then 'zh' when {_SAID['reliable'].format('run')} then {_SAID['language'].format('run', 'main')} else {_script_sql('run')} end as language from w where blank or not valid)"""


@R.query(_split_sql(_SPLIT + f""",
l as (select doc_id, seq, 0 as k, run as piece, language from o union all select doc_id, seq, 0, run, {_judged('run')} from w where valid and not blank)"""))
def split_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splitter with runs as tokens: main language, script runs, languages of runs, merged spans."""
    return _split(spark, sf_dir, None)


@R.query(_split_sql(_SPLIT + f""",
t as (select doc_id, seq, script, main, run, unnest(regexp_extract_all(run, '[^e]{{1,6}}|e+')) as piece, unnest(range(len(regexp_extract_all(run, '[^e]{{1,6}}|e+')))) as k from w where valid and not blank),
j as (select *, case when starts_with(piece, 'e') then null else {_judged('piece')} end as said from t),
q as (select *, first_value(nullif(said, 'und') ignore nulls) over (partition by doc_id, seq order by k rows between unbounded preceding and unbounded following) as known,
        count(nullif(said, 'und')) over (partition by doc_id, seq order by k rows between unbounded preceding and current row) as passed, count(said) over (partition by doc_id, seq) as tokens from j),
l as (select doc_id, seq, k, piece, case when tokens = 0 then main when said is null then 'und' when said = 'und' and passed = 0 then coalesce(known, 'und') else said end as language from q
      union all select doc_id, seq, 0, run, language from o)"""))
def split_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole splitter: the runs that the main language can have are parted into tokens, what stands between them is undetermined."""
    return _split(spark, sf_dir, _tokens)


def _split(spark: SparkSession, sf_dir: str, tokenize: D.Tokenizer | None) -> DataFrame:
    texts = _texts(spark, sf_dir).select("doc_id", "text", D.main_language(F.col("text"), F.col("label"), F.col("reliable")).alias("main"))
    return D.split_languages(texts, ["doc_id"], _said, tokenize=tokenize).select("doc_id", "seq", "language", F.md5("text").alias("text_md5"), "start", "end")


_ASKED = "case doc_id % 8 when 0 then ' Auto ' when 1 then lang || '-XX' when 2 then upper(lang) when 3 then 'ENGLISH' when 4 then 'Klingon' when 5 then '' when 6 then 'tlh_aa' else lang || '_us' end"
_CODE = "case doc_id % 7 when 0 then lang || '_us' when 1 then lang when 2 then 'auto' when 3 then 'xx-YY' when 4 then '  ' when 5 then upper(lang) || '-latn-x' end"
_CASE = lambda x, table: f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"
_BASE = lambda x: f"string_split(replace(lower(trim({x})), '_', '-'), '-')[1]"
_NAME_TABLE = LANGUAGES | {v.lower(): v for v in LANGUAGES.values()}
_ASKED_NAME = f"case when lower(trim(asked)) = 'auto' then 'Auto' else coalesce(case when regexp_matches(trim(asked), '[-_]') then {_CASE(_BASE('asked'), LANGUAGES)} end, {_CASE('lower(trim(asked))', _NAME_TABLE)}, trim(asked)) end"
_CANONICAL = "array_to_string(list_transform(list_filter(string_split(replace(trim(code), '_', '-'), '-'), lambda x: x <> ''), lambda x, i: case i when 1 then lower(x) when 2 then upper(x) else x end), '-')"
_ERROR = f"case when coalesce(lower(trim(code)), '') in ('', 'auto') then null when not contains({_CANONICAL}, '-') then 'no region' when {_CASE(_BASE('code'), LANGUAGES)} is null then 'unsupported language' end"


@R.query(f"with q as (select doc_id, {_ASKED} as asked, {_CODE} as code from documents) select doc_id, {_ASKED_NAME} as name, {_ERROR} as error from q")
def language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of requested languages, and why codes are refused."""
    asked = read(spark, sf_dir, "documents").select("doc_id", F.expr(_ASKED).alias("asked"), F.expr(_CODE).alias("code"))
    return asked.select("doc_id", X.language_name(F.col("asked")).alias("name"), X.code_error(F.col("code")).alias("error"))


@R.query(f"""
with q as (select doc_id, {_ASKED} as asked, {_CODE} as code, lang from documents), n as (select *, {_ASKED_NAME} as given, {_ERROR} as error, {_CANONICAL} as canonical, {_BASE('code')} as base, coalesce(trim(code), '') <> '' as has_code from q)
select doc_id, case when has_code and lower(trim(code)) = 'auto' then 'Auto' when has_code then case when error is null then {_CASE('base', LANGUAGES)} end
    when lower(trim(asked)) in ('', 'auto') then coalesce({_CASE('lang', LANGUAGES)}, 'Auto') else given end as name,
  case when has_code and lower(trim(code)) = 'auto' then 'multilingual' when has_code then case when error is null then canonical end
    when lower(trim(asked)) in ('', 'auto') then coalesce({_CASE('lang', LOCALES)}, 'multilingual')
    else coalesce({_CASE('coalesce(' + _CASE('lower(given)', {v.lower(): k for k, v in LANGUAGES.items()}) + ', ' + _BASE('asked') + ')', LOCALES)}, 'multilingual') end as locale from n""")
def resolved_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and locale of requests: by code, by language, by detection."""
    asked = read(spark, sf_dir, "documents").select("doc_id", F.expr(_ASKED).alias("asked"), F.expr(_CODE).alias("code"), "lang")
    name, locale = X.resolved_language(F.col("asked"), F.col("code"), F.col("lang"))
    return asked.select("doc_id", name.alias("name"), locale.alias("locale"))


QUERIES, ORACLE_SQL = R.queries, R.sql
