"""Rules that the driver's tables do not exercise: other scripts, golden ids, merged spans, streams."""

import random

from pyspark.sql import functions as F

from sonoglyph.dims import PHONEMES, PHONEMES_UK
from sonoglyph.functions import text as X
from sonoglyph.operators import phoneme as P, segment as S


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_golden_ids(spark):
    rows = spark.createDataFrame([(["l", "ˈ", "ɪ", "c", "̧", "t", "!"],)], "s array<string>")
    assert rows.select(P.phoneme_ids(F.col("s"))).first()[0] == [1, 0, 24, 0, 120, 0, 74, 0, 16, 0, 140, 0, 32, 0, 4, 0, 2]
    uk = spark.createDataFrame([(["в", "е", "с", "е", "́", "л", "к", "а"],)], "s array<string>")
    assert uk.select(P.phoneme_ids(F.col("s"), PHONEMES_UK)).first()[0] == [1, 0, 14, 0, 18, 0, 33, 0, 18, 0, 45, 0, 27, 0, 26, 0, 12, 0, 2]
    assert len(PHONEMES) == 159 and len(set(PHONEMES)) == 159 and len(PHONEMES_UK) == 49


def test_missing(spark):
    rows = spark.createDataFrame([(1, ["\0", "\0", "\0"])], "k int, s array<string>")
    assert rows.select(P.phoneme_ids(F.col("s"))).first()[0] == [1, 0, 2]
    assert [tuple(r) for r in P.missing_symbols(rows, ["k"], "s").collect()] == [(1, "\0", 3)]


def test_scripts_and_merge(spark):
    text = "Hello, мир! 漢字かな \U0001f600 end"
    runs = S.script_runs(spark.createDataFrame([(1, text), (2, "")], "k int, text string"), ["k"]).orderBy("seq").collect()
    assert "".join(r["run"] for r in runs) == text
    assert all(text[r["start"] : r["end"]] == r["run"] for r in runs)
    assert [r["script"] for r in runs if r["script"] != "Common"] == ["Latin", "Cyrillic", "Han", "Hiragana", "Latin"]


def fold(spans):
    out = []
    for lang, script in spans:
        if out and (lang == out[-1][0] or lang == "und"):
            out[-1][1].append(script)
        else:
            out.append([lang, [script]])
    if len(out) > 1 and out[0][0] == "und":
        out[1][2:] = [out[0][1]]
        out = out[1:]
    return [(lang, next((s for s in scripts if s != "Common"), "Common")) for lang, scripts, *_ in out]


def test_merge_is_the_fold(spark):
    rng = random.Random(3)
    texts = [[(rng.choice(["en", "ru", "und"]), rng.choice(["Latin", "Common", "Han"])) for _ in range(rng.randint(1, 8))] for _ in range(300)]
    rows = [(k, i, "x", i, i + 1, s, lang) for k, spans in enumerate(texts) for i, (lang, s) in enumerate(spans)]
    df = spark.createDataFrame(rows, "k int, seq int, run string, start int, end int, script string, language string")
    got = {}
    for r in S.merge_languages(df, ["k"]).orderBy("k", "seq").collect():
        got.setdefault(r["k"], []).append((r["language"], r["script"]))
    assert got == {k: fold(spans) for k, spans in enumerate(texts)}


def test_script_spans_are_the_merged_runs(spark):
    import contextlib
    import io

    from sonoglyph.plans import segments as Q

    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "C", " ", ", ", "мир", "漢字", "か", "カ", "\u0301", "é", "γ", "\U0001f600", "\n", "\ue000", "1"]) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    texts += ["", "  ", "\u0301", "\ue000 γ", "a\u0301 b" * 20_000]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, text string")
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in Q._NAMED.items() for x in kv)), F.col("script")), F.lit("und"))
    columns = ["k", "seq", "language", "text", "start", "end", "script"]
    want = S.merge_languages(S.script_runs(df, ["k"]).withColumn("language", label), ["k"]).select(columns)
    got = S.merged_scripts(df, ["k"], Q._NAMED)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        Q.merge_lang_islands(spark, "/root/testdata/sf0.001").explain()
    assert "collect_list" not in plan.getvalue()  # what held all runs of a span, and all texts in the shuffle


def test_text(spark):
    assert one(spark, X.normalize_punctuation, "你好。再见！……（a）") == "你好. 再见! ......(a)"
    assert [one(spark, X.normalize_locale, x) for x in ("en-us", "EN", "zh-hant-tw")] == ["en-US", "en", "zh"]
    assert one(spark, X.canonical_locale, " PT_br--x ") == "pt-BR-x"
    assert [one(spark, X.language_by_script, x) for x in ("漢字", "漢字かな", "かな", "привет", "שלום", "123")] == ["zh", "ja", "und", "ru", "he", "und"]
    assert [one(spark, X.milliseconds, x) for x in ("500ms", "1.5s", " 20 ", "x", None)] == [500, 1500, 20, None, None]
    assert one(spark, X.sanitize_prompt, "One. Two. Three and") == "One."
    assert one(spark, X.sanitize_prompt, "one, two  and the") == "one"
    assert [one(spark, X.voice_of, x) for x in (None, "en", "en-us", "zh_TW", "gl")] == ["en-us", "en-us", "en", "cmn-latn-pinyin", "es"]


def test_stream_equals_batch(spark, tmp_path):
    from sonoglyph.streaming.chunks import chunks, stream_chunks

    rows = spark.createDataFrame([(k, i, float(i * k)) for k in range(3) for i in range(30 + k)], "user long, `order` long, value double")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = stream_chunks(stream, "user", 12)
    q = made.writeStream.format("memory").queryName("made").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("made").groupBy("user").agg(F.count("*").alias("n"), F.sum("n_steps").alias("s")).collect()
    want = chunks(rows, "user", "order", 12).where("not is_final").groupBy("user").agg(F.count("*").alias("n"), F.sum("n_steps").alias("s")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
