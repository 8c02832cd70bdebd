import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoglyph.functions.markup import parse_ssml
from sonoglyph.sources import lines, wav


@pytest.mark.parametrize("dtype", ["u1", "i2", "i4", "f4", "f8"])
def test_wav_types(dtype):
    values = np.array([0, 1, 100, 7, 3], dtype)
    kind, channels, rate, depth, samples, error = wav.parse(wav.build(values, 8000))
    assert (channels, rate, depth, samples, error) == (1, 8000, 8 * values.dtype.itemsize, values.tolist(), None)
    assert kind == (3 if dtype[0] == "f" else 1)


def test_wav_odd_chunks_and_24_bits():
    head = struct.pack("<4sI4s", b"RIFF", 0, b"WAVE")
    junk = b"JUNK" + struct.pack("<I", 3) + b"abc\0"
    ext = struct.pack("<HHIIHHHHI", 0xFFFE, 1, 8000, 24000, 3, 24, 22, 24, 4) + struct.pack("<H", 1) + b"\0" * 14
    body = head + junk + b"fmt " + struct.pack("<I", len(ext)) + ext + b"data" + struct.pack("<I", 6) + b"\1\0\0\xff\xff\xff"
    assert wav.parse(body)[3:] == (24, [256, -256], None)
    assert wav.parse(b"nonsense")[5].startswith("bad file")


def test_wav_source(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.build(np.array([1, -1], "i2"), 16_000))
    (tmp_path / "b.wav").write_bytes(b"x")
    rows = {r["path"][-5:]: r for r in wav.read_wav(spark, str(tmp_path)).collect()}
    assert rows["a.wav"]["samples"] == [1.0, -1.0] and rows["b.wav"]["error"]


def test_lines(spark, tmp_path):
    (tmp_path / "in").write_text('{"text": "a", "speaker_id": 3}\n\nnot json\n{"phoneme_ids": [1, 2]}\n')
    got = lines.read_utterances(spark, str(tmp_path / "in")).collect()
    assert [(r["text"], r["speaker_id"], r["phoneme_ids"], r["error"] is None) for r in got] == [("a", 3, None, True), (None, None, None, False), (None, None, [1, 2], True)]
    lines.write_utterances(spark.range(2).select(F.col("id").alias("speaker_id")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    (tmp_path / "presets").write_text("one (x): a: b\nnothing\n")
    assert [tuple(r) for r in lines.read_presets(spark, str(tmp_path / "presets")).collect()] == [("one", "a: b")]


def test_ssml():
    text = lambda t, s=None: {"type": "text", "text": t, "speaker": s, "duration_ms": None}
    pause = lambda ms: {"type": "break", "text": None, "speaker": None, "duration_ms": ms}
    assert parse_ssml('<speak>a <b>b</b> c<break/>d<voice name="x">e<break time="1.5s"/></voice>f</speak>')[0] == [text("a b c"), pause(250), text("d"), text("e", "x"), pause(1500), text("f")]
    assert parse_ssml("<speak>")[1].startswith("bad markup") and parse_ssml("hi")[1] and parse_ssml(None)[1] and parse_ssml("<speaker/>")[1]
    assert parse_ssml('<speak><break time="soon"/></speak>')[1]


def test_diacritics(spark):
    from sonoglyph.functions import diacritics as D

    df = spark.createDataFrame([("\u0628\u0650\u0633\u0652\u0645\u0651\u064e", [22, 20, 7]), ("abc", [1, 8, 99, 5]), ("ab", [5]), ("", [5]), ("ab", []), (None, [5])], "t string, labels array<int>")
    s = D.without_marks(F.col("t"))
    got = df.select(s.alias("s"), D.with_marks(s, F.col("labels")).alias("r"), D.kept_places(F.col("t")).alias("k"), D.encoded(s, F.create_map(F.lit("a"), F.lit(7)), 4).alias("e")).collect()
    assert [r["s"] for r in got] == ["\u0628\u0633\u0645", "abc", "ab", "", "ab", None]
    assert [r["r"] for r in got] == ["\u0628\u0650\u0633\u0652\u0645\u064e\u0651", "abc", "a\u064eb", "", "ab", None]
    assert got[0]["k"] == [0, 2, 4] and got[1]["e"] == [7, 1, 1, 0] and got[3]["e"] == [0, 0, 0, 0]
    assert len(df.limit(1).select(D.encoded(F.repeat(F.lit("a"), 400), F.create_map(F.lit("a"), F.lit(7)))).first()[0]) == 315


def test_labels_are_made_once(spark):
    import time

    from sonoglyph.functions import diacritics as D

    df = spark.createDataFrame([("ab" * 4000,)] * 8, "t string").repartition(1)
    labels = F.transform(D.characters(F.col("t")), lambda c, i: (F.ascii(c) + i) % 29)  # of the text, as a model's are
    began = time.time()
    got = {r[0] for r in df.select(D.with_marks(F.col("t"), labels)).collect()}
    took = time.time() - began
    forms = {k: v for k, v in D.FORMS.items() if k not in D.NO_MARK}
    assert got == {"".join(c + forms.get((ord(c) + i) % 29, "") for i, c in enumerate("ab" * 4000))}
    assert took < 20  # over a minute when each character makes all labels again
