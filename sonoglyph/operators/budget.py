"""Token budgets from sampled durations, by quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOP, RATE, STEPS_PER_SECOND = 256, 22_050, 12


def budgets(samples: DataFrame, key: list[str], frames: str, *, quantile: float = 0.9, min_margin: float = 0.9, max_margin: float = 1.25, min_extra: int = 0, max_extra: int = 36) -> DataFrame:
    """Estimated, least and most tokens for each key, from the quantile of sampled frames (linear between samples, half to even)."""
    tokens = F.col(frames) * HOP / RATE * STEPS_PER_SECOND
    q = F.percentile
    sums = samples.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.ceil(F.round(q(frames, F.lit(quantile)), 6)).alias("mel_frames"), F.round(q(F.col(frames) * HOP / RATE, F.lit(quantile)), 6).alias("seconds"),
        F.greatest(F.lit(1), F.bround(F.round(q(tokens, F.lit(quantile)), 6), 0).cast("long")).alias("estimate"))
    least = F.greatest(F.lit(1), F.bround(F.col("estimate") * min_margin, 0).cast("long") + min_extra)
    most = F.bround(F.col("estimate") * max_margin, 0).cast("long") + max_extra
    return sums.select("*", least.alias("min_tokens"), F.greatest(least, most).alias("max_tokens"))
