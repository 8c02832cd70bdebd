"""Text as columns: normalisation, locales, scripts and prompts. All are built-in expressions; null in, null out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from sonoglyph.dims import INCOMPLETE_ENDINGS, LANGUAGES, LOCALES, LONG_CODES, PUNCTUATION


def strip(text: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_punctuation(text: Column) -> Column:
    """Full-width and other scripts' punctuation as ASCII: one character to one by translate, the others one by one."""
    single = {k: v for k, v in PUNCTUATION.items() if len(v) == 1}
    text = F.translate(text, "".join(single), "".join(single.values()))
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), ((k, v) for k, v in PUNCTUATION.items() if len(v) > 1), text)


def normalize_locale(code: Column) -> Column:
    """``xx-YY`` of a code of exactly two parts, else its first part alone."""
    parts = F.split(F.lower(code), "-")
    return F.when(F.size(parts) == 2, F.concat(parts[0], F.lit("-"), F.upper(parts[1]))).otherwise(parts[0])


def canonical_locale(code: Column) -> Column:
    """Lower-case base, upper-case region and the rest as it is; empty parts are dropped."""
    parts = F.filter(F.split(F.replace(strip(code), F.lit("_"), F.lit("-")), "-"), lambda p: p != "")
    return F.concat_ws("-", F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(i == 1, F.upper(p)).otherwise(p)))


def locale_base(code: Column) -> Column:
    return F.substring_index(F.replace(F.lower(strip(code)), F.lit("_"), F.lit("-")), "-", 1)


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def language_key(code: Column) -> Column:
    """Name of a language by its whole code or its base, else the code; ``default`` for an empty one."""
    names = {k: v.lower() for k, v in LANGUAGES.items()} | {k: LANGUAGES[v].lower() for k, v in LONG_CODES.items()}
    names |= {v: v for v in [*names.values(), "auto", "default", "multilingual"]}
    key, table = F.replace(F.lower(strip(code)), F.lit("_"), F.lit("-")), _map(names)
    found = F.coalesce(F.element_at(table, key), F.element_at(table, F.substring_index(key, "-", 1)), key)
    return F.when(F.coalesce(code, F.lit("")) == "", "default").otherwise(found)


def voice_of(code: Column, primary: str = "en-us") -> Column:
    """Voice of a detected language; only exactly ``en`` is the primary voice, ``en-us`` and the like are ``en``."""
    key = F.replace(F.lower(strip(code)), F.lit("_"), F.lit("-"))
    base = F.substring_index(key, "-", 1)
    return (
        F.when(F.coalesce(code, F.lit("")) == "", "en-us")
        .when((base == "yue") | key.isin("zh-hk", "zh-yue"), "yue").when(base.isin("zh", "cmn"), "cmn-latn-pinyin")
        .when(base.isin("jv", "su"), "id").when(base == "gl", "es").when(base == "mn", "ru").when(code == "en", primary).otherwise(base))


def effective_language(language: Column, main: Column) -> Column:
    """The span's language unless it is null, empty or undetermined; then the main one; then English. In lower case."""
    return F.lower(F.coalesce(F.nullif(F.nullif(language, F.lit("und")), F.lit("")), F.nullif(main, F.lit("")), F.lit("en")))


def language_name(requested: Column) -> Column:
    """Name of a requested language: ``Auto``, the name of a locale's base, of a code or of a name in any case, else as given."""
    asked = strip(requested)
    key, names = F.lower(asked), _map(LANGUAGES | {v.lower(): v for v in LANGUAGES.values()})
    of_locale = F.when(asked.rlike("[-_]"), F.element_at(_map(LANGUAGES), locale_base(asked)))
    return F.when(key == "auto", "Auto").otherwise(F.coalesce(of_locale, F.element_at(names, key), asked))


def code_error(code: Column) -> Column:
    """Why a language code is refused: it names no region, or no supported language; null if it is not."""
    locale, asked = canonical_locale(code), F.lower(strip(code))
    known = F.element_at(_map(LANGUAGES), locale_base(locale)).isNotNull()
    return F.when(F.coalesce(asked, F.lit("")).isin("", "auto"), None).when(~F.contains(locale, F.lit("-")), "no region").when(~known, "unsupported language")


def resolved_language(language: Column, code: Column, detected: Column) -> tuple[Column, Column]:
    """Name and locale of a request: by its code if it has one, else by its language, else by the detected code; an
    undetected language is ``Auto`` and ``multilingual``. A refused code (``code_error``) gives nulls."""
    names, locales = _map(LANGUAGES), _map(LOCALES)
    has_code = F.coalesce(strip(code), F.lit("")) != ""
    auto_code, asked = F.lower(strip(code)) == "auto", strip(F.coalesce(language, F.lit("")))
    auto = F.lower(asked).isin("", "auto")
    name = language_name(asked)
    by_name = _map({v.lower(): k for k, v in LANGUAGES.items()})
    base = F.coalesce(F.element_at(by_name, F.lower(name)), locale_base(asked))
    found = F.coalesce(detected, F.lit(""))
    return (
        F.when(has_code & auto_code, "Auto").when(has_code, F.when(code_error(code).isNull(), F.element_at(names, locale_base(code))))
        .when(auto, F.coalesce(F.element_at(names, found), F.lit("Auto"))).otherwise(name),
        F.when(has_code & auto_code, "multilingual").when(has_code, F.when(code_error(code).isNull(), canonical_locale(code)))
        .when(auto, F.coalesce(F.element_at(locales, found), F.lit("multilingual"))).otherwise(F.coalesce(F.element_at(locales, base), F.lit("multilingual"))))


def language_weight(text: Column) -> Column:
    """Number of letters and numbers; combining marks do not count."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What ``body`` makes of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def outside_latin(text: Column) -> Column:
    """What a text has but Latin letters and characters of no script of their own: empty for most texts."""
    # ASCII is Latin or common; told by its number, it is not looked up
    return F.regexp_replace(text, r"[\x00-\x7f\p{IsLatin}\p{IsCommon}\p{IsInherited}\p{IsUnknown}]+", "")


def is_latin_only(text: Column) -> Column:
    """Nothing but Latin letters and characters of no script of their own."""
    return ~text.rlike(r"[^\p{IsLatin}\p{IsCommon}\p{IsInherited}\p{IsUnknown}]")


def has_han_without_kana(text: Column) -> Column:
    return text.rlike(r"\p{IsHan}") & ~text.rlike(r"[\p{IsHiragana}\p{IsKatakana}]")


# Scripts that a language is guessed from, in the order in which they are looked for.
SCRIPT_LADDER = [
    ("Hangul", "ko"), ("Thai", "th"), ("Devanagari", "hi"), ("Arabic", "ar"), ("Hebrew", "he"), ("Greek", "el"), ("Cyrillic", "ru"), ("Tamil", "ta"), ("Telugu", "te"), ("Bengali", "bn"),
    ("Latin", "en"),
]


def language_by_script(text: Column, rest: Column | None = None) -> Column:
    """A language guessed from scripts alone; ``rest`` is ``outside_latin`` of the text, if it is known."""
    if rest is None:
        return let(outside_latin(text), lambda r: language_by_script(text, r))
    has = lambda s: rest.rlike(rf"\p{{Is{s}}}")
    ladder = F.when(has("Han"), F.when(rest.rlike(r"[\p{IsHiragana}\p{IsKatakana}]"), "ja").otherwise("zh"))
    for script, code in SCRIPT_LADDER[:-1]:
        ladder = ladder.when(has(script), code)
    latin = F.when(text.rlike(r"\p{IsLatin}"), "en").otherwise("und")
    return F.when(rest == "", latin).otherwise(F.coalesce(ladder, latin))


def sanitize_prompt(text: Column) -> Column:
    """White space collapsed; a text whose last word leaves it open is cut after its last but one sentence, else at its last comma."""
    flat = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    last = F.lower(F.try_element_at(F.regexp_extract_all(flat, F.lit("[A-Za-z']+"), F.lit(0)), F.lit(-1)))
    ends = F.size(F.regexp_extract_all(flat, F.lit("[.!?。！？]"), F.lit(0)))
    sentence = strip(F.regexp_extract(flat, r"^(?s)(.*[.!?。！？])[^.!?。！？]*[.!?。！？][^.!?。！？]*$", 1))
    comma = F.regexp_extract(flat, r"^(?s)(.+)[,，、][^,，、]*$", 1)
    return F.when(last.isin(*INCOMPLETE_ENDINGS) & (ends >= 2), sentence).when(last.isin(*INCOMPLETE_ENDINGS) & (comma != ""), strip(comma)).otherwise(flat)


def milliseconds(time: Column) -> Column:
    """``500ms``, ``1.5s`` or a bare number of milliseconds, cut to whole ones; null for anything else."""
    t = F.lower(strip(time))
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)"
    return (
        F.when(t.rlike(f"^{number}ms$"), F.expr("cast(0 as double)") + F.regexp_replace(t, "ms$", "").try_cast("double"))
        .when(t.rlike(f"^{number}s$"), F.regexp_replace(t, "s$", "").try_cast("double") * 1000)
        .when(t.rlike(f"^{number}$"), t.try_cast("double")).cast("int"))


def without_flags(phonemes: Column) -> Column:
    """Without language switches in parentheses, the last of which may be open."""
    return F.regexp_replace(phonemes, r"\([^)]*(\)|$)", "")


def is_enabled(value: Column, default: bool | None = None) -> Column:
    """Whether a setting is on; a missing one has the default."""
    on = F.lower(strip(value)).isin("1", "true", "yes", "on")
    return on if default is None else F.coalesce(on, F.lit(default))


def preview(text: Column, most: int = 50) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
