"""Anchoring metrics as Column expressions; NaN is guarded everywhere by hand,
because SQL orders it above all numbers while the definitions follow IEEE."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from mooring.functions.bind import let

#: Fixed value: decimal logarithm to bits, as truncated by convention.
LOG10_TO_BITS = 3.321928
EPSILON_BITS, EPSILON_RANGE = 1e-12, 1e-9
WINDOW = 50
_INF = float("inf")


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite; never null itself."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < _INF), F.lit(False))


def all_finite(*cs: Column) -> Column:
    out = finite(cs[0])
    for c in cs[1:]:
        out = out & finite(c)
    return out


def bits_per_token(log10_sum: Column, n_tokens: Column) -> Column:
    """Bits a token of a summed decimal log-likelihood."""
    return log10_sum / n_tokens * F.lit(LOG10_TO_BITS)


def ln_to_log10(c: Column) -> Column:
    return c / F.lit(math.log(10))


def _clip01(c: Column) -> Column:
    # least and greatest skip nulls, and NaN is above every number to them
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)))


def probabilistic_anchoring(base: Column, final: Column) -> Column:
    """Share of the answer's cost the trace saves: ``clip((final - base) / -base, 0, 1)``.

    0 where the cost is NaN or not above 1e-12, or where either end is null (fewer
    than two points); NaN where the quotient is.
    """
    h = -base
    gain = (final - base) / h
    return F.when(base.isNull() | final.isNull() | F.isnan(h) | (h <= EPSILON_BITS), F.lit(0.0)).otherwise(_clip01(gain))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _variance(a: Column) -> Column:
    return let(_mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))


def segment_means(entropies: Column, bounds: Column) -> Column:
    """Mean of each segment between neighbouring bounds, empty segments left out."""
    def spans(e: Column, b: Column) -> Column:
        pairs = F.when(F.size(b) < 2, F.array().cast("array<struct<a:int,b:int>>")).otherwise(F.transform(F.slice(b, 2, F.size(b)), lambda x, i: F.struct(F.element_at(b, i + 1).alias("a"), x.alias("b"))))
        return F.transform(F.filter(pairs, lambda p: F.least(p["b"], F.size(e)) > p["a"]), lambda p: let(F.slice(e, p["a"] + 1, p["b"] - p["a"]), _mean))

    return let(F.struct(entropies.alias("e"), bounds.alias("b")), lambda x: spans(x["e"], x["b"]))


def window_bounds(n: Column, width: int = WINDOW) -> Column:
    """Bounds of tumbling windows of ``width`` tokens; the last may be shorter."""
    return F.array_append(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / width).cast("int") - 1, F.lit(0))), lambda i: i * width), n)


def entropy_of_means(means: Column) -> Column:
    """Entropic anchoring of the segment means of one trace.

    Fewer than two give 0; the means are scaled to 0-1 (all 0 if their range is
    not above 1e-9 or any is NaN); global uniformity is 1 - variance / 0.25, local
    uniformity exp(-std/mean) of the absolute differences, both with population
    moments; the result is sqrt((1 - local) * global).
    """
    return F.when(means.isNull(), F.lit(0.0)).otherwise(let(means, lambda v: F.when(F.size(v) < 2, F.lit(0.0)).otherwise(let(_normalised(v), _uniformity))))


def _normalised(v: Column) -> Column:
    def scale(r: Column) -> Column:
        flat = r["nan"] | (r["high"] - r["low"] <= EPSILON_RANGE)
        return F.transform(v, lambda x: F.when(flat, F.lit(0.0)).otherwise((x - r["low"]) / (r["high"] - r["low"])))

    return let(F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high"), F.exists(v, F.isnan).alias("nan")), scale)


def _uniformity(z: Column) -> Column:
    def of(d: Column) -> Column:
        mean = _mean(d)
        local = F.when(mean > EPSILON_RANGE, F.exp(-F.sqrt(_variance(d)) / mean)).otherwise(F.lit(1.0))
        return F.sqrt((1 - local) * (F.lit(1.0) - F.least(_variance(z) / 0.25, F.lit(1.0))))

    steps = F.transform(F.slice(z, 2, F.size(z)), lambda x, i: F.abs(x - F.element_at(z, i + 1)))
    return let(steps, of)


def entropy_anchoring(entropies: Column, bounds: Column) -> Column:
    """Entropic anchoring of a series of token entropies.

    ``bounds``: end offsets of the steps. As the ends are passed without a leading
    0, the first step doesn't count; put 0 in front to make it count.
    """
    return F.when(entropies.isNull() | (F.size(entropies) < 2), F.lit(0.0)).otherwise(entropy_of_means(segment_means(entropies, bounds)))


def scaled(aprob: Column) -> Column:
    """``sqrt(clip(Aprob, 0, 1))``; NaN stays NaN, null stays null."""
    return F.sqrt(_clip01(aprob))


def sampled_steps(n: Column) -> Column:
    """Steps at which the answer is scored: all up to 50, then every fourth, and the last."""
    m = F.greatest(n, F.lit(0))
    return F.filter(F.sequence(F.lit(0), m), lambda i: (i <= 50) | ((i - 50) % 4 == 0) | (i == m))


def prefix_end(ends: Column, step: Column) -> Column:
    """Tokens of the trace before the answer is asked for at ``step``."""
    return F.when((step == 0) | (F.size(ends) == 0), F.lit(0)).otherwise(F.element_at(ends, F.least(step, F.size(ends))))


def step_ends(step_sizes: Column, separator: int = 0) -> Column:
    """Cumulative end offset of each step; a separator stands before every one but the first."""
    # running sums in one pass: the last sum is the end of the array built so far
    sums = F.aggregate(step_sizes, F.array().cast("array<int>"), lambda acc, n: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)) + separator, F.lit(0)) + n))
    return let(sums, lambda x: F.when(F.size(x) == 0, F.array(F.lit(0))).otherwise(x))
