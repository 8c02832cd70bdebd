"""Invertible maps and index shifts over arrays: splines, flows, relative positions, folding and padding. All are built-in
expressions; sums over a slice stand for running sums, since these arrays are short."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from sonoglyph.functions.text import let

# Least width, height and slope of a spline's bins, and what the last knot is moved by when bins are looked up.
LEAST_WIDTH, LEAST_HEIGHT, LEAST_SLOPE, KNOT_SHIFT = 1e-3, 1e-3, 1e-3, 1e-6
# Fixed value: logarithms are taken of no less.
LEAST_LOG = 1e-5


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def softmax(x: Column) -> Column:
    powers = lambda top: F.transform(x, lambda v: F.exp(v - top))
    return let(F.array_max(x), lambda top: let(powers(top), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s))))


def _knots(sizes: Column, least: float, bound: float) -> Column:
    """Bounds of the bins between -bound and bound, of sizes in proportion to a softmax, none less than ``least``."""
    n = F.size(sizes)

    def placed(parts: Column) -> Column:
        inner = lambda i: 2 * bound * total(F.transform(F.slice(parts, F.lit(1), i), lambda v: least + (1 - least * n) * v)) - bound
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, -bound).when(i == n, bound).otherwise(inner(i)))

    return let(softmax(sizes), placed)


def spline_bins(widths: Column, heights: Column, slopes: Column, bound: float = 1.0) -> Column:
    """The knots (x, y, d) of a monotonic rational-quadratic spline: K widths and heights, K - 1 slopes of the inner knots,
    none of them normalised; at both ends the slope is 1, so that linear tails go on smoothly."""
    edge = F.lit(math.log(math.exp(1 - LEAST_SLOPE) - 1))
    d = F.transform(F.concat(F.array(edge), slopes, F.array(edge)), lambda v: LEAST_SLOPE + F.log1p(F.exp(-F.abs(v))) + F.greatest(v, F.lit(0.0)))
    return F.struct(_knots(widths, LEAST_WIDTH, bound).alias("x"), _knots(heights, LEAST_HEIGHT, bound).alias("y"), d.alias("d"))


def spline(value: Column, bins: Column, bound: float = 1.0, inverse: bool = False) -> Column:
    """(value, log_det) of the spline of ``spline_bins`` at a value, or of its inverse; outside the bound the value itself and 0."""
    along = bins["y"] if inverse else bins["x"]
    k = F.size(F.filter(F.slice(along, F.lit(1), F.size(along) - 1), lambda v: v <= value))  # bins are counted from 1
    at = lambda name, i: F.get(bins[name], i)
    bin_ = lambda i: F.struct(
        at("x", i - 1).alias("x"), (at("x", i) - at("x", i - 1)).alias("w"), at("y", i - 1).alias("y"), (at("y", i) - at("y", i - 1)).alias("h"), at("d", i - 1).alias("d0"), at("d", i).alias("d1"))

    def in_bin(b: Column) -> Column:
        delta = b["h"] / b["w"]
        bend = b["d0"] + b["d1"] - 2 * delta

        def mapped(t: Column) -> Column:
            both = t * (1 - t)
            below = delta + bend * both
            slope = delta * delta * (b["d1"] * t * t + 2 * delta * both + b["d0"] * (1 - t) * (1 - t))
            log_det = F.log(slope) - 2 * F.log(below)
            out = t * b["w"] + b["x"] if inverse else b["y"] + b["h"] * (delta * t * t + b["d0"] * both) / below
            return F.struct(out.alias("value"), (-log_det if inverse else log_det).alias("log_det"))

        if not inverse:
            return let((value - b["x"]) / b["w"], mapped)
        up = value - b["y"]
        p, q, r = up * bend + b["h"] * (delta - b["d0"]), b["h"] * b["d0"] - up * bend, -delta * up
        return let(2 * r / (-q - F.sqrt(F.greatest(q * q - 4 * p * r, F.lit(0.0)))), mapped)

    return F.when(F.abs(value) <= bound, let(let(k, bin_), in_bin)).otherwise(F.struct(value.alias("value"), F.lit(0.0).alias("log_det")))


def affine(x: Column, shift: Column, log_scale: Column, inverse: bool = False) -> Column:
    """Entry by entry ``shift + exp(log_scale) * x``, or its inverse."""
    terms = F.arrays_zip(x.alias("x"), shift.alias("m"), log_scale.alias("s"))
    return F.transform(terms, lambda t: (t["x"] - t["m"]) * F.exp(-t["s"]) if inverse else t["m"] + F.exp(t["s"]) * t["x"])


def log_flow(x: Column, inverse: bool = False) -> Column:
    return F.transform(x, lambda v: F.exp(v) if inverse else F.log(F.greatest(v, F.lit(LEAST_LOG))))


def flip(x: Column) -> Column:
    """The channels in reverse order; its own inverse."""
    return F.reverse(x)


def absolute_positions(rows: Column) -> Column:
    """Of n rows of 2n - 1 values by relative position (j - i + n - 1) the n x n values by place j."""
    n = F.size(rows)
    return F.transform(rows, lambda r, i: F.slice(r, n - i, n))


def relative_positions(rows: Column) -> Column:
    """Of n rows of n values by place j those by relative position, zero where there is no such place."""
    n = F.size(rows)
    return F.transform(rows, lambda r, i: F.concat(F.array_repeat(F.lit(0.0), n - 1 - i), r, F.array_repeat(F.lit(0.0), i)))


def banded_scores(queries: Column, keys: Column, window: int) -> Column:
    """Scores of n queries with 2 * window + 1 keys of relative positions, by place: the dot product within the window, else 0."""
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    places = F.sequence(F.lit(0), F.size(queries) - 1)
    return F.transform(queries, lambda q, i: F.transform(places, lambda j: F.when(F.abs(j - i) <= window, dot(q, F.get(keys, j - i + window))).otherwise(0.0)))


def folded(x: Column, period: Column) -> Column:
    """Rows of ``period`` values; the last one is filled up by reflection at the end of ``x``, which is longer than a period."""
    missing = F.pmod(-F.size(x), period)
    full = F.when(missing > 0, F.concat(x, F.reverse(F.slice(x, F.size(x) - missing, missing)))).otherwise(x)
    return let(full, lambda f: F.transform(F.sequence(F.lit(0), (F.size(f) / period).cast("int") - 1), lambda r: F.slice(f, r * period + 1, period)))


def padded(x: Column, kernel: int, causal: bool) -> Column:
    """Zeros around ``x`` for a convolution of the same length: all before it if causal, else on both sides, one more behind."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return F.concat(zeros(kernel - 1), x) if causal else F.concat(zeros((kernel - 1) // 2), x, zeros(kernel // 2))
