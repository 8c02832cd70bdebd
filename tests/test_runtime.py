"""Settings from environments, and speakers by each fallback."""

import pytest
from pyspark.sql import functions as F

from sonoglyph.operators import runtime as O

def given():
    return F.struct(*(F.lit(v).alias(f) for f, v in {"mode": "config", **dict.fromkeys(O.STRINGS, "given"), **dict.fromkeys(O.INTEGERS, 7), **dict.fromkeys(O.BOOLEANS, True)}.items()))


@pytest.mark.parametrize(("env", "want"), [
    (None, {"mode": "config", "dtype": "given", "max_seq_len": 7, "warmup": True}),
    ({}, {"mode": "config", "attn": "given"}),
    ({"PRECISION_MODE": " MAX "}, {"mode": "aggressive", "extra_precision": "fp16_inner", "dtype": "auto"}),
    ({"PRECISION_MODE": "", "OPTIMIZED": "no"}, {"mode": "bf16", "attn": "sdpa"}),
    ({"PRECISION_MODE": "  ", "OPTIMIZED": "no"}, {"mode": "config", "attn": "given"}),
    ({"OPTIMIZED": "Yes"}, {"mode": "optimized"}),
    ({"PRECISION_MODE": "off", "ATTN": " eager "}, {"mode": "custom", "attn": "eager", "audio_dtype": "same"}),
    ({"MODEL": "m", "DEVICE": " "}, {"mode": "config", "model": "m", "device": "given"}),
    ({"MAX_SEQ_LEN": " 12 ", "MAX_NEW_TOKENS": " "}, {"max_seq_len": 12, "max_new_tokens": 7}),
    ({"WARMUP": "", "PRELOAD": "maybe", "XVEC_ONLY": " ON "}, {"warmup": False, "preload": False, "xvec_only": True, "preload_background": True}),
    ({"PRECISION_MODE": "warp"}, {"error": "unknown mode warp", "mode": None, "model": None}),
    ({"MAX_SEQ_LEN": "many"}, {"error": "max_seq_len is no number: many", "mode": None}),
])
def test_runtime_settings(spark, env, want):
    df = spark.createDataFrame([(env,)], "env map<string,string>")
    got = df.select(O.runtime_settings(F.col("env"), given()).alias("s")).first()["s"].asDict()
    assert {k: got[k] for k in want} == want and ("error" in want or got["error"] is None)


def test_speakers(spark):
    ids = spark.createDataFrame([("es", 5, 0), ("cmn-latn-pinyin", 2, 1), ("it", 3, 2)], "label string, speaker_id int, place int")
    mapped = spark.createDataFrame([("fr", "it"), ("de", "nobody")], "base string, label string")
    cases = [("fr", "es", ("it", 3, "fr", 1)), ("zh", None, ("cmn-latn-pinyin", 2, "cmn-latn-pinyin", 1)), ("gl", "", ("es", 5, "es", 1)), ("de", "it", ("it", 3, "it", 2)), ("und", "es", ("es", 5, "es", 1)),
             (None, None, ("es", 0, "es", 4)), ("xx", "yy", ("es", 0, "es", 4))]
    spans = spark.createDataFrame([(i, language, main) for i, (language, main, _) in enumerate(cases)], "id int, language string, main string")
    got = {r["id"]: (r["speaker"], r["speaker_id"], r["voice"], r["step"]) for r in O.speakers_with_fallbacks(spans, ids, mapped).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(cases)}
    primary = spark.createDataFrame([("en-gb", 9, 0)], "label string, speaker_id int, place int")
    assert {(r["speaker"], r["step"]) for r in O.speakers_with_fallbacks(spans.where("id = 6"), primary, mapped).collect()} == {("en-gb", 3)}
    none = O.speakers_with_fallbacks(spans.where("id = 6"), ids.where("false"), mapped.where("false")).collect()
    assert [(r["speaker"], r["speaker_id"], r["voice"], r["step"]) for r in none] == [("en", 0, "en-us", 4)]
