"""Token sampling over arrays of logits, a token's id being its place: penalty, top k, top p, softmax, greedy choice.

A row is one step's logits, so nothing is shuffled; work is linear in the vocabulary but for the sorts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: The largest 32-bit floating number.
_MOST = 3.4028234663852886e38


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def numbered(logits: Column) -> Column:
    """(token, logit) of each logit."""
    return F.transform(logits, lambda x, i: F.struct(i.alias("token"), x.alias("logit")))


def repetition_penalty(logits: Column, history: Column, penalty: float) -> Column:
    """Logits of tokens in the history (repeats count once) divided by the penalty if positive, else times it."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(history, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def suppress(logits: Column, last: int, end: int) -> Column:
    """Minus infinity for the last ids of a vocabulary but the end id."""
    return F.transform(logits, lambda x, i: F.when((i >= F.size(logits) - last) & (i != end), F.lit(float("-inf"))).otherwise(x))


def suppress_end(logits: Column, end: int, step: Column, least: int) -> Column:
    """Minus infinity for the end id until ``least`` steps are made."""
    return F.transform(logits, lambda x, i: F.when((i == end) & (step < least), F.lit(float("-inf"))).otherwise(x))


def top_k(logits: Column, k: int) -> Column:
    """(token, logit) of the logits that are at least the k-th largest; ties at the border stay."""
    least = F.coalesce(F.get(F.sort_array(logits, asc=False), k - 1), F.array_min(logits))
    return let(least, lambda m: F.filter(numbered(logits), lambda s: s["logit"] >= m))


def finite(logit: Column) -> Column:
    """A logit as a finite number: 0 for NaN, the largest or least 32-bit number for an infinity."""
    return F.when(F.isnan(logit), 0.0).when(logit == float("inf"), _MOST).when(logit == float("-inf"), -_MOST).otherwise(logit)


def softmax(logits: Column) -> Column:
    """Probabilities; logits are made finite first."""
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    raised = let(F.transform(logits, finite), lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))))
    return let(raised, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def top_p(logits: Column, p: float) -> Column:
    """(token, p) of the most probable tokens whose probabilities sum up to p at most, in their order; the first stays in
    any case, the one that crosses p does not."""
    ranked = F.array_sort(F.zip_with(numbered(logits), softmax(logits), lambda s, q: F.struct((-s["logit"]).alias("o"), s["token"].alias("token"), q.alias("p"))))
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"))
    count = lambda r: F.aggregate(r, start, lambda a, s: F.struct((a["mass"] + s["p"]).alias("mass"), (a["n"] + F.when((a["mass"] + s["p"] <= p) | (a["n"] == 0), 1).otherwise(0)).alias("n")))["n"]
    return let(ranked, lambda r: F.transform(F.slice(r, 1, count(r)), lambda s: F.struct(s["token"].alias("token"), s["p"].alias("p"))))


def greedy(logits: Column) -> Column:
    """The token of the largest logit, of equal ones the smallest."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def sampled(logits: Column, u: Column) -> Column:
    """The token at which the running sum of probabilities exceeds ``u`` (0 to 1)."""
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"))
    step = lambda a, q: F.struct((a["mass"] + q).alias("mass"), (a["n"] + F.when(a["mass"] + q <= u, 1).otherwise(0)).alias("n"))
    return F.least(F.aggregate(softmax(logits), start, step)["n"], F.size(logits) - 1)


def until_end(steps: DataFrame, key: list[str], end: int) -> DataFrame:
    """(key, n_steps): steps (key, step, token) before the first end id, or all."""
    return steps.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("token") == end, F.col("step"))), F.count(F.lit(1))).alias("n_steps"))
