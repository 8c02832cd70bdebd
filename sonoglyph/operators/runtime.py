"""Settings of a session from its environment, and the speaker of a span by a chain of fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sonoglyph.functions.text import is_enabled, strip, voice_of

PRECISION = ["dtype", "audio_dtype", "attn", "layer_precision", "predictor_layer_precision", "audio_decoder_precision", "large_block_precision", "extra_precision", "linear_precision"]
# The precisions that each mode sets, and the names that it goes by.
MODES = {
    "optimized": ["auto", "auto", "auto", "auto", "none", "none", "none", "none", "none"],
    "balanced": ["auto", "auto", "auto", "auto", "0,1,3,4", "none", "none", "none", "none"],
    "aggressive": ["auto", "auto", "auto", "auto", "0,1,3,4", "fp16", "fp16", "fp16_inner", "none"],
    "bf16": ["bfloat16", "same", "sdpa", "none", "none", "none", "none", "none", "none"],
}
MODE_NAMES = {
    "optimized": "optimized", "auto": "optimized", "fp16": "optimized", "mixed": "optimized", "stable": "optimized", "balanced": "balanced",
    "aggressive": "aggressive", "max": "aggressive", "maximum": "aggressive", "bf16": "bf16", "bfloat16": "bf16", "off": "bf16", "disabled": "bf16", "original": "bf16",
}
STRINGS, INTEGERS = ["model", "device", *PRECISION], ["max_seq_len", "max_new_tokens", "voice_prompt_cache_entries"]
BOOLEANS = ["preload", "preload_background", "warmup", "xvec_only", "non_streaming_mode"]


def asked_mode(mode: Column, optimized: Column) -> Column:
    """The mode that is asked for: by its name, or by an older switch if that is null or empty; a blank name asks for none."""
    named = F.nullif(F.lower(strip(mode)), F.lit(""))
    return F.when(F.coalesce(mode, F.lit("")) != "", named).otherwise(F.when(is_enabled(optimized), "optimized").when(optimized.isNotNull(), "bf16"))


def runtime_settings(env: Column, given: Column) -> Column:
    """The settings ``given`` (mode and the fields of STRINGS, INTEGERS and BOOLEANS) after an environment, a map from their names
    in upper case, PRECISION_MODE and OPTIMIZED to text.

    A mode sets all precisions; then each variable that is not blank sets its own field, and one of a precision makes the mode
    ``custom``. Booleans are set by any text, blank ones included. An unknown mode and a broken number are errors, which
    leave all fields null. A null map changes nothing.
    """
    of = lambda name: F.element_at(env, name.upper())
    text = {f: F.nullif(strip(of(f)), F.lit("")) for f in [*STRINGS, *INTEGERS]}
    asked = asked_mode(of("PRECISION_MODE"), of("OPTIMIZED"))
    mode = F.element_at(F.create_map(*(F.lit(x) for kv in MODE_NAMES.items() for x in kv)), asked)
    by_mode = F.element_at(F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv)), mode)
    numbers = {f: F.when(text[f].rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(text[f], F.lit("_"), F.lit("")).try_cast("int")) for f in INTEGERS}
    error = F.coalesce(F.when(asked.isNotNull() & mode.isNull(), F.concat(F.lit("unknown mode "), asked)), *(F.when(text[f].isNotNull() & numbers[f].isNull(), F.concat(F.lit(f"{f} is no number: "), text[f])) for f in INTEGERS))
    custom = F.coalesce(*(text[f] for f in PRECISION)).isNotNull()
    out = {"mode": F.when(custom, "custom").otherwise(F.coalesce(mode, given["mode"]))}
    out |= {f: F.coalesce(text[f], *([by_mode[PRECISION.index(f)]] if f in PRECISION else []), given[f]) for f in STRINGS}
    out |= {f: F.coalesce(numbers[f], given[f]) for f in INTEGERS}
    out |= {f: F.coalesce(F.when(of(f).isNotNull(), F.coalesce(is_enabled(of(f)), F.lit(False))), given[f]) for f in BOOLEANS}
    return F.struct(*(F.when(error.isNull(), v).alias(k) for k, v in out.items()), error.alias("error"))


def speaker_candidates(language: Column, primary: str) -> tuple[Column, Column, Column]:
    """Of a language its voice, that voice's base, and the labels that a speaker of it may have, the best first."""
    voice = voice_of(F.coalesce(F.nullif(language, F.lit("")), F.lit("en")), primary)
    base = F.when(F.startswith(voice, F.lit("en")), "en").otherwise(voice)
    some = F.when((base == "cmn") | F.startswith(base, F.lit("cmn-latn")), F.array(F.lit("zh"), F.lit("cmn-latn-pinyin"))).when(base == "en", F.array(F.lit("en"), F.lit("en-us"), F.lit("en-gb"))).otherwise(F.array(base))
    return voice, base, some


def speakers_with_fallbacks(spans: DataFrame, speakers: DataFrame, mapped: DataFrame, primary: str = "en-us") -> DataFrame:
    """``spans`` (language, main, ...) with speaker, speaker_id, voice and step: the speaker of the span's language (1), of the main
    one (2), of the primary one (3), else the first label (4), which speaks as number 0; ``en`` where there is no speaker.

    ``speakers`` (label, speaker_id, place) and ``mapped`` (base, label) are small tables of a model: they become one row of maps,
    and a span is looked up without a shuffle. A mapped label without a speaker counts for nothing.
    """
    first = speakers.orderBy("place", "label").limit(1).select(F.col("label").alias("_first"))
    ids = speakers.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("speaker_id", "label")))).alias("_ids"))
    bases = mapped.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("base", "label"))).alias("_bases"))
    model = ids.join(bases).join(first, how="left")
    language = F.lower(F.coalesce(F.nullif(F.nullif("language", F.lit("und")), F.lit("")), F.nullif("main", F.lit("")), F.lit("en")))
    found = []
    for step, asked in ((1, language), (2, F.when(F.coalesce(F.col("main"), F.lit("")) != "", F.col("main"))), (3, F.lit(primary.split("-")[0]))):
        voice, base, some = speaker_candidates(asked, primary)
        known = F.transform(F.concat(F.array(F.element_at("_bases", base)), some), lambda label: F.element_at("_ids", label))
        best = F.get(F.filter(known, lambda s: s.isNotNull()), F.lit(0))
        found.append(F.when(asked.isNotNull() & best.isNotNull(), F.struct(best["label"].alias("speaker"), best["speaker_id"].cast("long").alias("speaker_id"), voice.alias("voice"), F.lit(step).alias("step"))))
    last = F.coalesce("_first", F.lit("en"))
    found.append(F.struct(last.alias("speaker"), F.lit(0).cast("long").alias("speaker_id"), voice_of(last, primary).alias("voice"), F.lit(4).alias("step")))
    return spans.join(F.broadcast(model)).withColumn("_s", F.coalesce(*found)).select(*spans.columns, "_s.*")
