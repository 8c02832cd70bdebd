"""Sample arrays as columns: levels, frames, trimming, conversion, alignment. Arrays are doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def peak(samples: Column) -> Column:
    return F.greatest(F.array_max(F.transform(samples, F.abs)), F.lit(0.01))


def to_int16(samples: Column) -> Column:
    """Scaled so that the peak (0.01 at least) is full scale, clipped, cut toward zero."""
    scale = F.lit(32767.0) / peak(samples)
    return F.transform(samples, lambda x: F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), x * scale)).cast("smallint"))


def rounded(value: Column, digits: int) -> Column:
    """A double to so many digits after the point, halves away from zero. Unlike ``F.round`` it keeps the sign of what becomes
    zero (-0.0), as SQL engines that round binary numbers do; numbers too large to scale stay."""
    scaled = value * float(10**digits)
    whole = F.rint(scaled)
    away = F.when(F.abs(scaled - whole) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(whole)
    return F.when(F.abs(scaled) < float("inf"), away / float(10**digits)).otherwise(value)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def frame_rms(samples: Column, size: int, hop: int) -> Column:
    """Root mean squares of frames of a size every hop; zeros fill the last frame."""
    n = F.size(samples)
    padding = F.greatest(F.lit(0), F.lit(size) - n % hop)
    padded = F.concat(samples, F.array_repeat(F.lit(0.0), padding))
    starts = F.sequence(F.lit(0), F.size(padded) - size, F.lit(hop))
    return F.transform(starts, lambda s: F.sqrt(total(F.transform(F.slice(padded, s + 1, size), lambda x: x * x)) / size))


def voiced_bounds(rms: Column, n: Column, size: int, hop: int, pad: int, absolute_db: float = -45.0, relative_db: float = -35.0) -> Column:
    """Struct of the first and the last sample to keep: frames above a threshold that is absolute or relative to the loudest, and a pad."""
    threshold = F.greatest(F.lit(10 ** (absolute_db / 20)), F.array_max(rms) * (10 ** (relative_db / 20)))
    voiced = F.filter(F.transform(rms, lambda r, i: F.when(r > threshold, i)), lambda i: i.isNotNull())
    start = F.greatest(F.lit(0), F.element_at(voiced, 1) * hop - pad)
    stop = F.least(n, F.element_at(voiced, -1) * hop + size + pad)
    none = F.size(voiced) == 0
    return F.struct(F.when(none, 0).otherwise(start).alias("start"), F.when(none, n).otherwise(stop).alias("stop"))


def silence_samples(milliseconds: Column, rate: int) -> Column:
    return F.floor(milliseconds * rate / 1000)


def silence(milliseconds: Column, rate: int) -> Column:
    return F.array_repeat(F.lit(0).cast("smallint"), silence_samples(milliseconds, rate).cast("int"))


def duration_path(durations: Column) -> Column:
    """The token of each frame: frame t is token i's if the durations up to i are the first to exceed t."""
    return F.flatten(F.transform(durations, lambda d, i: F.array_repeat(i, d.cast("int"))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def bin_of(x: Column, edges: Column) -> Column:
    """How many edges x reaches, less one."""
    return F.size(F.filter(edges, lambda e: x >= e)) - 1
