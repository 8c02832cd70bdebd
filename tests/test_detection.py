"""Cases of language choice that scripts and settling characters decide, whatever a detector would say."""

import pytest
from pyspark.sql import functions as F

from sonoglyph.operators import detect as D

# Text and main language; a detector that knows nothing says und.
MAIN = [
    ("これはテスト", "ja"), ("これは日本語", "ja"), ("1000円", "ja"), ("峠", "ja"), ("あ", "ja"), ("ア", "ja"), ("東京タワー", "ja"), ("안녕하세요", "ko"), ("가", "ko"), ("한글", "ko"),
    ("สวัสดีครับ", "th"), ("Україна", "uk"), ("Γειά σου κόσμε", "el"), ("שלום עולם", "he"), ("مرحبا عالم", "ar"), ("这是一个测试", "zh"), ("你好世界", "zh"), ("2025年9月28日", "zh"), ("第1章", "zh"), ("山", "zh"),
    ("國語", "zh"), ("100元", "zh"), ("你好！世界。", "zh"), ("Hello, world", "en"), ("OK", "en"), ("100kg", "en"), ("12345", "und"), ("50%", "und"), ("$100", "und"), ("2+2=4", "und"), ("😀😀😀", "und"), ("", "und"),
]
# Text, main language and the languages of its spans.
SPANS = [
    ("Hello世界", "en", ["en", "zh"]), ("世界Hello", "zh", ["zh", "en"]), ("Hello日本語です", "en", ["en", "zh"]), ("안녕 Hello 세상", "ko", ["ko", "en", "ko"]), ("Привет Hello мир", "ru", ["ru", "en", "ru"]),
    ("مرحبا Hello عالم", "ar", ["ar", "en", "ar"]), ("Hello123世界", "en", ["en", "zh"]), ("  Hello", "en", ["en"]), ("123!@#", "und", ["und"]), ("", "und", []), ("我是学生", "zh", ["zh"]), ("Hello。世界", "en", ["en", "zh"]),
]


def test_main_language(spark):
    texts = spark.createDataFrame(MAIN, "text string, want string")
    for label, reliable in (("und", False), ("wo", True), ("zz", True)):
        got = texts.withColumn("got", D.main_language(F.col("text"), F.lit(label), F.lit(reliable)))
        # a label that nothing speaks against is believed outside Latin text
        believed = got.where("got <> want" + (" and got <> 'zz'" if label == "zz" else "")).collect()
        assert not believed, believed
    biased = texts.where("want = 'zh'").select(D.main_language(F.col("text"), F.lit("ja"), F.lit(True)).alias("m")).distinct().collect()
    assert [r["m"] for r in biased] == ["zh"]


@pytest.mark.parametrize("text,main,want", SPANS)
def test_spans(spark, text, main, want):
    def said(run, main):
        return F.struct(main.alias("language"), F.lit(1.0).alias("probability"), F.lit(1.0).alias("main_probability"), F.lit(False).alias("reliable"))

    rows = D.split_languages(spark.createDataFrame([(1, text, main)], "id int, text string, main string"), ["id"], said).orderBy("start").collect()
    assert [r["language"] for r in rows] == want and "".join(r["text"] for r in rows) == text
    assert all(text[r["start"] : r["end"]] == r["text"] for r in rows)


def test_confusable_languages_stay(spark):
    said = F.struct(F.col("top").alias("language"), F.col("p").alias("probability"), F.lit(0.0).alias("main_probability"))
    rows = [("no", "da", 0.97, "no"), ("no", "da", 0.98, "da"), ("nl", "af", 1.0, "nl"), ("es", "pt", 0.1, "pt"), ("en", "wo", 1.0, "en"), ("zh", "ja", 0.9, "zh"), ("fr", "fr", 1.0, "fr")]
    df = spark.createDataFrame(rows, "main string, top string, p double, want string")
    script = F.when(F.col("main") == "zh", "Han").otherwise("Latin")
    assert not df.where(D.biased_language(F.lit("x"), F.col("main"), script, said) != F.col("want")).collect()
    assert df.limit(1).select(D.biased_language(F.lit("山か"), F.lit("en"), F.lit("Han"), said)).first()[0] == "ja"


# Text, main language and languages that its spans must have; the detector knows scripts alone, tokens are words or single characters.
SWITCHES = [
    ("This is English これは日本語です", "en", {"en", "ja"}), ("Hello    世界", "en", {"en", "zh"}), ("Hello,世界", "en", {"en", "zh"}), ("Hello123世界", "en", {"en", "zh"}), ("안녕Hello", "ko", {"ko", "en"}),
    ("Hello 世界 and 안녕", "ko", {"en", "zh", "ko"}), ("This is 中文 and これ and 한글", "ja", {"en", "ja", "ko"}), ("English 中文 English 中文", "en", {"en", "zh"}),
]
# Text, main language and the number of its spans.
MERGED = [("100块钱", "zh", 1), ("1000円", "ja", 1), ("Hello!", "en", 1), ("你好！", "zh", 1), ("Hello world", "en", 1), ("Hello 世界 world", "en", 3)]


def _by_script(run, main):
    code = D.language_by_script(run)
    language = F.when(run.rlike(r"[\p{IsHiragana}\p{IsKatakana}]"), "ja").when(code == "und", main).when((code == "zh") & (main == "ja"), "ja").otherwise(code)
    return F.struct(language.alias("language"), F.lit(0.99).alias("probability"), F.lit(0.0).alias("main_probability"), F.lit(True).alias("reliable"))


@pytest.mark.parametrize("tokenize", [None, lambda run, main: F.split(run, ""), lambda run, main: F.regexp_extract_all(run, F.lit(r"\w+"), F.lit(0))])
def test_switches_and_merges(spark, tokenize):
    rows = [(t, m, sorted(want), 0) for t, m, want in SWITCHES] + [(t, m, [], n) for t, m, n in MERGED]
    got = D.split_languages(spark.createDataFrame(rows, "text string, main string, want array<string>, n int"), ["want", "n"], _by_script, tokenize=tokenize)
    texts = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, main string, want array<string>, n int")
    spans = D.split_languages(texts, ["id", "want", "n"], _by_script, tokenize=tokenize).collect()
    for i, (text, _, want, n) in enumerate(rows):
        mine = sorted((r for r in spans if r["id"] == i), key=lambda r: r["seq"])
        assert "".join(r["text"] for r in mine) == text and all(text[r["start"] : r["end"]] == r["text"] for r in mine)
        assert set(want) <= {r["language"] for r in mine} and (not n or len(mine) == n), (text, mine)
        assert all(a["language"] != b["language"] for a, b in zip(mine, mine[1:], strict=False))
    assert got.count() == len(spans)


def test_tokens_within_runs(spark):
    """A token between others of the main language is a span; gaps are undetermined; tokens that are not found count for nothing."""
    said = {"bbb": "fr", "ccc": "fr", "uuu": "und"}

    def detect(run, main):
        language = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in said.items() for x in kv)), run), main)
        return F.struct(language.alias("language"), F.lit(0.99).alias("probability"), F.lit(0.0).alias("main_probability"), F.lit(True).alias("reliable"))

    cases = [
        ("aaabbbccc", ["aaa", "bbb", "ccc"], [("aaa", "en"), ("bbbccc", "fr")]),
        ("xbbbxcccx", ["bbb", "ccc"], [("xbbbxcccx", "fr")]),
        ("aaa xbbb", ["bbb"], [("aaa x", "en"), ("bbb", "fr")]),
        ("aaabbb", ["AAA", "bbb", ""], [("aaabbb", "fr")]),
        ("aaabbb", ["zzz"], [("aaabbb", "en")]),
        ("bbbuuu aaa", ["bbb", "uuu", "aaa"], [("bbbuuu ", "fr"), ("aaa", "en")]),
        ("aaa uuubbb", ["aaa", "uuu", "bbb"], [("aaa ", "en"), ("uuubbb", "fr")]),
        ("aaa", [], [("aaa", "en")]),
        (None, ["a"], []), ("", ["a"], []),
    ]
    texts = spark.createDataFrame([(i, t, "en", k) for i, (t, k, _) in enumerate(cases)], "id int, text string, main string, tokens array<string>")
    for i, (_, tokens, want) in enumerate(cases):
        fixed = lambda run, main, tokens=tokens: F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")
        got = D.split_languages(texts.where(f"id = {i}"), ["id"], detect, tokenize=fixed).orderBy("seq").collect()
        assert [(r["text"], r["language"]) for r in got] == want


def test_runs_are_judged_once_and_numbers_start_anew(monkeypatch):
    import random

    import pyarrow as pa

    monkeypatch.setattr(D, "_AT_ONCE", 64)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "C", " ", ", ", "\u043c\u0438\u0440", "\u6f22", "\u0301", "\ue000", "x", "\U0001f600"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts[3], texts[7] = None, ""
    starts, scripts = [0, 65, 91, 97, 123, 0x300, 0x370, 0x400, 0x500, 0x4E00, 0xA000, 0xE000, 0xF900], ["Common", "Latin", "Common", "Latin", "Common", "Inherited", "Common", "Cyrillic", "Common", "Han", "Common", "Unknown", "Common"]
    said = {"Latin": "en", "Cyrillic": "ru", "Han": "zh"}
    rows = pa.record_batch({"id": pa.array(range(300)), "_text": pa.array(texts, pa.string()), "_main": pa.array([rng.choice(["en", "ru", None]) for _ in texts], pa.string())})

    def spans(most):
        monkeypatch.setattr(D, "_MOST", most)
        entries = []
        coded = []
        for b in D._coded_runs(["id"], starts, scripts)(iter([rows.slice(0, 100), rows.slice(100)])):
            new = [[{"script": e["script"], "parts": [{"n": len(e["run"]), "language": said.get(e["script"], "und")}]} for e in r] for r in b.column("_new").to_pylist()]
            entries += [(e["run"], e["main"]) for r in b.column("_new").to_pylist() for e in r]
            kind = pa.list_(pa.struct([("script", pa.string()), ("parts", pa.list_(pa.struct([("n", pa.int32()), ("language", pa.string())])))]))
            coded.append(b.drop_columns(["_new"]).append_column("_new", pa.array(new, kind)))
        # batches are made anew on the way, here of 7 rows
        whole = pa.Table.from_batches(coded).combine_chunks()
        return entries, pa.Table.from_batches(D._span_rows(iter(whole.to_batches(max_chunksize=7)))).to_pylist()

    once, want = spans(1 << 20)
    assert len(once) == len(set(once)) > 20
    again, got = spans(5)
    assert len(again) > len(once) and got == want
    for i, t in enumerate(texts):
        own = [r for r in want if r["id"] == i]
        assert "".join(r["text"] for r in own) == (t or "") and all(t[r["start"] : r["end"]] == r["text"] for r in own)
        assert [r["seq"] for r in own] == list(range(1, len(own) + 1)) and all(a["language"] != b["language"] for a, b in zip(own, own[1:], strict=False))
