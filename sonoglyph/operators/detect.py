"""Language choice over scripts, settling characters and a detector's label, which is a column or an expression of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from sonoglyph.dims import BANNED_LATIN, COMMON_LATIN, CONFUSABLE, DEFAULT_THRESHOLD, MARKERS, SCRIPT_LANGUAGES, SCRIPT_THRESHOLDS, SCRIPTS
from sonoglyph.functions.text import SCRIPT_LADDER, has_han_without_kana, language_by_script, let, outside_latin
from sonoglyph.operators.segment import script_of

#: What a detector says of a text: its label, how sure it is of it and of the main language, and whether it is reliable.
Detector = Callable[[Column, Column], Column]
#: The tokens of a run in order, given the main language; characters between them belong to none.
Tokenizer = Callable[[Column, Column], Column]


def marker_language(text: Column) -> Column:
    """The first language of which the text has a script or character that no other has; null without one."""
    return let(outside_latin(text), _marked)


def _marked(rest: Column) -> Column:
    """``marker_language`` of what a text has outside Latin; all settling characters are there."""
    return F.when(rest != "", F.coalesce(*(F.when(rest.rlike(f"[{''.join(rf'\p{{Is{x}}}' for x in scripts)}{letters}]"), code) for code, scripts, letters in MARKERS)))


def script_set(text: Column) -> Column:
    """Sorted names of the scripts in a text, but for common, inherited and unknown ones; of scripts without a name here, none."""
    runs = F.regexp_extract_all(text, F.lit("|".join(rf"\p{{Is{s}}}+" for s in SCRIPTS)), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(F.transform(runs, lambda r: F.left(r, F.lit(1)))), script_of)))


def allowed(detections: Column, languages: list[str] | None, k: int = 3) -> Column:
    """The first k detections (language, probability) in the allowed languages, Chinese in one code; else ``und`` alone."""
    one = F.transform(F.filter(F.slice(detections, 1, k), lambda d: d["language"] != "un"), lambda d: F.struct(
        F.when(F.startswith(d["language"], F.lit("zh")), "zh").otherwise(d["language"]).alias("language"), d["probability"].alias("probability")))
    kept = one if languages is None else F.filter(one, lambda d: d["language"].isin(*languages))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.struct(F.lit("und").alias("language"), F.lit(1.0).alias("probability"))))


def main_language(text: Column, detected: Column, reliable: Column) -> Column:
    """A text's main language: by settling characters, else the detector's label unless it is of a kind that is often wrong."""

    def chosen(rest: Column) -> Column:
        latin, by_script = rest == "", language_by_script(text, rest)
        han_alone = rest.rlike(r"\p{IsHan}") & ~rest.rlike(r"[\p{IsHiragana}\p{IsKatakana}]")
        said = (
            F.when((F.coalesce(detected, F.lit("und")) == "und") | detected.isin(*BANNED_LATIN) | latin & ~detected.isin(*COMMON_LATIN), by_script)
            .when((detected == "ja") & han_alone, "zh").when(~F.coalesce(reliable, F.lit(False)) & latin, "en").otherwise(detected))
        return F.coalesce(_marked(rest), said)

    return let(outside_latin(text), chosen)


def _table(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def script_valid(script: Column, language: Column) -> Column:
    """Whether text of a language can be in a script: one that several share, or one that settles the language."""
    languages = {s: [code] for code, scripts, _ in MARKERS for s in scripts} | SCRIPT_LANGUAGES
    return script.isin("Common", "Inherited", "Unknown") | F.coalesce(F.array_contains(F.element_at(_table(languages), script), language), F.lit(False))


def threshold(script: Column, main: Column, detected: Column) -> Column:
    """Least confidence in the detected language and most in the main one for a switch, as a pair."""
    pairs = {f"{a} {b}": list(pair) for codes, pair in reversed(CONFUSABLE) for a in codes for b in codes}
    languages = F.element_at(_table(SCRIPT_LANGUAGES), script)
    shared = F.when(F.array_contains(languages, main) & F.array_contains(languages, detected), F.element_at(_table({k: list(v) for k, v in SCRIPT_THRESHOLDS.items()}), script))
    return F.coalesce(F.element_at(_table(pairs), F.concat_ws(" ", main, detected)), shared, F.lit(list(DEFAULT_THRESHOLD)))


def biased_language(text: Column, main: Column, script: Column, said: Column) -> Column:
    """A span's language: the detector's word, but the main language where two are easily confused and it is not quite sure."""
    top = said["language"]

    def switched(pair: Column) -> Column:
        sure = (said["probability"] > pair[0]) & (F.coalesce(said["main_probability"], F.lit(0.0)) < pair[1])
        return F.when((pair[0] > 0.9) & ~sure, main).otherwise(top)

    return (
        F.when((script == "Han") & ~main.isin("zh", "ja"), F.when(has_han_without_kana(text), "zh").otherwise("ja"))
        .when(top.isNull() | (top == main) | top.isin(*BANNED_LATIN), main).otherwise(let(threshold(script, main, top), switched)))


def _pieces(run: Column, script: Column, main: Column, detect: Detector, tokenize: Tokenizer | None) -> Column:
    """(n, language) of the parts of a run whose script the main language can have: its tokens, found one after another, and what
    stands between them, which is undetermined. Tokens that are not found count for nothing; a run without any is the main
    language's. Undetermined tokens are the token's before them, at the run's beginning the first determined one's."""

    def judged(token: Column) -> Column:
        return let(detect(token, main), lambda said: biased_language(token, main, script, said))

    if tokenize is None:
        return F.array(F.struct(F.length(run).alias("n"), judged(run).alias("language")))
    piece = lambda n, language: F.struct(n.cast("int").alias("n"), language.alias("language"))
    none = F.array().cast("array<struct<n:int,language:string>>")

    def add(acc: Column, token: Column) -> Column:
        at = F.when(token != "", F.position(token, run, acc["at"]))
        gap = F.when(at > acc["at"], F.array(piece(at - acc["at"], F.lit(None).cast("string")))).otherwise(none)
        found = F.struct((at + F.length(token)).cast("int").alias("at"), F.concat(acc["pieces"], gap, F.array(piece(F.length(token), judged(token)))).alias("pieces"))
        return F.when(at > 0, found).otherwise(acc)

    def settled(x: Column) -> Column:
        known = F.get(F.filter(x["pieces"], lambda p: p["language"] != "und"), F.lit(0))["language"]
        first = F.array_position(F.transform(x["pieces"], lambda p: p["language"] != "und"), True)
        led = F.transform(x["pieces"], lambda p, i: F.struct(p["n"].alias("n"), F.when(p["language"].isNull(), "und").when((p["language"] == "und") & (i < first - 1), known).otherwise(p["language"]).alias("language")))
        rest = F.length(run) - x["at"] + 1
        return F.when(F.size(led) == 0, F.array(piece(F.length(run), main))).when(rest > 0, F.concat(led, F.array(piece(rest, F.lit("und"))))).otherwise(led)

    return let(F.aggregate(tokenize(run, main), F.struct(F.lit(1).alias("at"), none.alias("pieces")), add), settled)


#: Characters that are parted into runs at once, and runs with their main language that are told apart before counting starts anew.
_AT_ONCE, _MOST = 1 << 19, 1 << 18


@lru_cache(maxsize=1)
def _script_table(spark: SparkSession) -> tuple[list[int], list[str]]:
    """Where stretches of code points of one script begin, and their scripts, as ``script_of`` names them."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    named = ["Common", "Inherited", *SCRIPTS]
    stretches = "|".join(rf"\p{{Is{x}}}+" for x in named) + f"|[^{''.join(rf'\p{{Is{x}}}' for x in named)}]+"
    runs = F.regexp_extract_all(F.lit(bytearray("".join(map(chr, points)).encode())).cast("string"), F.lit(stretches), F.lit(0))
    found = spark.range(1).select(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), script_of(r).alias("script"))).alias("r")).first()[0]
    at = np.cumsum([0, *(r["n"] for r in found)])[:-1]
    return [points[i] for i in at], [r["script"] for r in found]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of rows whose sizes come to ``most`` together, of one row at least."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _lists(parts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in units of ``width`` bytes, and the bytes, of a binary or string array without nulls."""
    offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
    data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return (offsets - offsets[0]) // width, data


def _coded_runs(key: list[str], starts: list[int], scripts: list[str]):
    """Per text its runs of one script: for each the number of its entry (run, script, main); for one of n common characters -2 n, of n
    inherited ones -2 n - 1. A row's ``_new`` are the entries that no row before it had, numbered on;
    no row from here on has one below ``_base``."""
    names = sorted(set(scripts))
    common, inherited, unknown = (names.index(x) if x in names else -1 for x in ("Common", "Inherited", "Unknown"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.repeat(np.array([names.index(x) for x in scripts], np.int8), np.diff([*starts, 0x110000]))
        numbers: dict[tuple[str | None, str], int] = {}
        base = top = 0
        for b in batches:
            text, main = pc.fill_null(b.column("_text"), ""), b.column("_main")
            for lo, hi in _slices(np.asarray(pc.binary_length(text)), _AT_ONCE):
                if len(numbers) > _MOST:
                    numbers, base = {}, top
                bounds, data = _lists(text.slice(lo, hi - lo), 1)
                points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
                kinds = table[points]
                places = np.append(0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800).astype(np.int8) + (points >= 0x10000)))  # in bytes
                rows = np.searchsorted(places, bounds)  # where texts begin, in characters
                first = np.append(True, kinds[1:] != kinds[:-1]) if len(kinds) else np.zeros(0, bool)
                first |= kinds == unknown
                first[rows[:-1][rows[:-1] < len(kinds)]] = True
                heads = np.flatnonzero(first)
                lens = np.diff(np.append(heads, len(kinds))).astype(np.int32)
                kind = kinds[heads]
                row_heads = np.searchsorted(heads, rows)
                codes = np.where(kind == common, -2 * lens, np.where(kind == inherited, -2 * lens - 1, 0)).astype(np.int32)
                told = np.flatnonzero(codes == 0)
                new: list[dict] = []
                if len(told):
                    # spoken runs by their bytes; those between them are values too, which are not looked at
                    cuts = places[np.append(heads, len(kinds))].astype(np.int32)
                    strings = pa.StringArray.from_buffers(len(heads), pa.py_buffer(cuts), pa.py_buffer(data.tobytes()))
                    known = strings.take(pa.array(told)).dictionary_encode()
                    words, mains = known.dictionary, main.slice(lo, hi - lo).dictionary_encode(null_encoding="encode")
                    row = np.searchsorted(row_heads, told, "right") - 1
                    pair = np.asarray(mains.indices, np.int64)[row] * len(words) + np.asarray(known.indices, np.int64)
                    if len(mains.dictionary) * len(words) <= 8 * _AT_ONCE:
                        seen = np.zeros(len(mains.dictionary) * len(words), np.int32)
                        seen[pair] = 1
                        pairs = np.flatnonzero(seen)
                        seen[pairs] = np.arange(len(pairs))
                        at = seen[pair]
                    else:
                        pairs, at = np.unique(pair, return_inverse=True)
                    kind_of = np.zeros(len(words), np.int8)
                    kind_of[np.asarray(known.indices)] = kind[told]
                    own, said = words.to_pylist(), mains.dictionary.to_pylist()
                    number = np.empty(len(pairs), np.int32)
                    for i, p in enumerate(pairs.tolist()):
                        m, w = divmod(p, len(own))
                        n = numbers.get((said[m], own[w]))
                        if n is None:
                            n = numbers[said[m], own[w]] = top
                            top += 1
                            new.append({"run": own[w], "script": names[kind_of[w]], "main": said[m]})
                        number[i] = n
                    codes[told] = number[at]
                blob = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((row_heads * 4).astype(np.int32)), pa.py_buffer(codes.tobytes())])
                entries = pa.array([new] + [[]] * (hi - lo - 1), _ENTRIES)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in key), text.slice(lo, hi - lo), blob, pa.array(np.full(hi - lo, base), pa.int32()), entries],
                                                 [*key, "_text", "_codes", "_base", "_new"])

    return run


_ENTRIES = pa.list_(pa.struct([("run", pa.string()), ("script", pa.string()), ("main", pa.string())]))


def _spans(offsets: np.ndarray, n: np.ndarray, language: np.ndarray, script: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the parts of texts, whose languages and scripts are numbers (0: undetermined, common): the bounds of each text's spans,
    and starts, ends, scripts and languages. A span's script is that of its first determined part, without one the first that is
    not Common."""
    size, counts = len(n), np.diff(offsets)
    known, named = language != 0, script != 0
    begin = np.repeat(offsets[:-1], counts)
    at = np.arange(size)
    before = np.maximum.accumulate(np.where(known, at, -1)) if size else at
    after = np.minimum.accumulate(np.where(known, at, size)[::-1])[::-1] if size else at
    # the part whose language each one has: the last determined one, at the text's beginning the first; -1 without any
    own = np.where(before >= begin, before, np.where(after < np.repeat(offsets[1:], counts), after, -1))
    filled = np.append(language, 0)[own]
    first = (at == begin) | np.append(True, filled[1:] != filled[:-1])[:size]
    heads = np.flatnonzero(first)
    ends = np.cumsum(n, dtype=np.int64)
    base = np.append(0, ends)[begin[heads]]
    start = (ends - n)[heads] - base
    tail = np.append(heads[1:], size)[: len(heads)] - 1
    lead = own[heads]
    next_named = np.minimum.accumulate(np.where(named, at, size)[::-1])[::-1][heads] if size else heads
    speaks = np.where(lead >= 0, lead, np.where(next_named <= tail, next_named, heads))
    return np.append(0, np.cumsum(first))[offsets], start, ends[tail] - base, script[speaks], filled[heads]


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of ``_coded_runs`` after ``_new`` has got each entry's parts."""
    languages, scripts = {"und": 0, None: 0}, {"Common": 0, "Inherited": 1}
    base = 0
    begin, count, kind = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)  # of entries from base on
    part_n, part_language = np.zeros(0, np.int32), np.zeros(0, np.int32)
    for b in batches:
        new = b.column("_new").flatten()
        if len(new):
            parts, own = new.field("parts"), new.field("script").dictionary_encode()
            values, sizes = parts.flatten(), np.asarray(pc.list_value_length(parts), np.int32)
            said = values.field("language").dictionary_encode(null_encoding="encode")
            code = lambda table, names: np.array([table.setdefault(x, len(set(table.values()))) for x in names.to_pylist()], np.int32)
            begin = np.append(begin, len(part_n) + np.cumsum(sizes, dtype=np.int64) - sizes)
            count, kind = np.append(count, sizes), np.append(kind, code(scripts, own.dictionary)[np.asarray(own.indices)])
            part_n = np.append(part_n, np.asarray(values.field("n"), np.int32))
            part_language = np.append(part_language, code(languages, said.dictionary)[np.asarray(said.indices)])
        names = [[k for k, v in table.items() if v == i][0] for table in (languages, scripts) for i in range(len(set(table.values())))]
        parted = len(set(languages.values()))
        language_names, script_names = pa.array(names[:parted], pa.string()), pa.array(names[parted:], pa.string())
        for lo, hi in _slices(np.asarray(pc.binary_length(b.column("_codes"))) // 4, _AT_ONCE // 4):
            part = b.slice(lo, hi - lo)
            bounds, codes = _lists(part.column("_codes"), 4)
            codes = codes.view(np.int32)
            blank = codes < 0
            entry = np.where(blank, 0, codes - base)
            counts = np.ones(len(codes), np.int32)
            counts[~blank] = count[entry[~blank]]
            ends = np.cumsum(counts, dtype=np.int64)
            from_ = np.repeat(np.arange(len(codes)), counts)
            spoken = ~blank[from_]
            n, language = -codes[from_] // 2, np.zeros(len(from_), np.int32)
            source = (np.arange(len(from_)) - np.repeat(ends - counts, counts))[spoken] + begin[entry[from_[spoken]]]
            n[spoken], language[spoken] = part_n[source], part_language[source]
            script = -codes[from_] & 1
            script[spoken] = kind[entry[from_[spoken]]]
            bounds, start, end, script, language = _spans(np.append(0, ends)[bounds], n, language, script)
            row = np.repeat(np.arange(hi - lo), np.diff(bounds))
            texts = part.column("_text").to_pylist()
            text = [texts[r][x:y] for r, x, y in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)]
            keys = part.drop_columns(["_text", "_codes", "_base", "_new"]).take(pa.array(row))
            seq = np.arange(len(row)) - bounds[:-1][row] + 1 if len(row) else row
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(seq, pa.int64()), pa.array(text, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                                              script_names.take(pa.array(script)), language_names.take(pa.array(language))], [*keys.schema.names, "seq", "text", "start", "end", "script", "language"])
        if b.num_rows and (gone := b.column("_base")[-1].as_py() - base):
            cut = int(begin[gone]) if gone < len(begin) else len(part_n)
            base, begin, count, kind = base + gone, begin[gone:] - cut, count[gone:], kind[gone:]
            part_n, part_language = part_n[cut:], part_language[cut:]


def split_languages(texts: DataFrame, key: list[str], detect: Detector, main: str = "main", text: str = "text", tokenize: Tokenizer | None = None) -> DataFrame:
    """(key, seq, text, start, end, script, language) of the spans of one language of ``texts`` (key, text, main).

    Texts are parted into runs of one script. Common runs are undetermined; a run in a script that the main language cannot
    have is what the detector says, if reliably, else what its script says; any other is parted into tokens, each judged
    with a bias for the main language (without ``tokenize`` the run is one token). Adjacent parts of one language are one
    span; undetermined ones join the part before them, at the text's beginning the first determined one. Null and empty
    texts have no span. ``detect`` and ``tokenize`` depend on nothing but their arguments.

    All of it happens without a shuffle, and in order: a run is judged with its main language where a task meets the two first,
    in that row; the rows after it refer to it by a number. Only spans become rows.
    """
    by_script = _table(dict(SCRIPT_LADDER) | {"Han": "zh"})

    def parts(run: Column, script: Column, main_: Column) -> Column:
        whole = lambda language: F.array(F.struct(F.length(run).alias("n"), language.alias("language")))
        foreign = lambda said: F.when(F.coalesce(said["reliable"], F.lit(False)), said["language"]).otherwise(F.coalesce(F.element_at(by_script, script), F.lit("und")))
        return (
            F.when(script_valid(script, main_), _pieces(run, script, main_, detect, tokenize))
            .when(script == "Han", whole(F.lit("zh"))).otherwise(whole(let(detect(run, main_), foreign))))

    rows = texts.select(*key, F.col(main).alias("_main"), F.col(text).alias("_text"))
    keys = [*texts.select(*key).schema]
    entries = ArrayType(StructType([StructField(x, StringType()) for x in ("run", "script", "main")]))
    coded = StructType([*keys, StructField("_text", StringType()), StructField("_codes", BinaryType()),
                        StructField("_base", IntegerType()), StructField("_new", entries)])
    judged = F.transform("_new", lambda e: F.struct(e["script"].alias("script"), parts(e["run"], e["script"], e["main"]).alias("parts")))
    rows = rows.mapInArrow(_coded_runs(key, *_script_table(texts.sparkSession)), coded).withColumn("_new", judged)
    schema = StructType([*keys, StructField("seq", LongType()), StructField("text", StringType()), StructField("start", IntegerType()),
                         StructField("end", IntegerType()), StructField("script", StringType()), StructField("language", StringType())])
    return rows.mapInArrow(_span_rows, schema)
