"""Logarithm of factorials as a column expression (Spark has no log-gamma)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# ln(n!) for n below 12, and the Stirling series used from there on.
SMALL_LN_FACTORIAL = [math.log(math.factorial(n)) for n in range(12)]
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680]


def ln_factorial(n: Column) -> Column:
    """ln(n!) of a non-negative whole number, good to double precision."""
    x = n.cast("double")
    safe = F.greatest(x, F.lit(12.0))
    terms = [F.lit(c) / F.pow(safe, F.lit(float(2 * k + 1))) for k, c in enumerate(STIRLING)]
    series = reduce(lambda a, b: a + b, terms)
    large = (safe + 0.5) * F.log(safe) - safe + F.lit(0.5 * math.log(2 * math.pi)) + series
    small = F.element_at(
        F.array(*[F.lit(v) for v in SMALL_LN_FACTORIAL]),
        F.least(n, F.lit(11)).cast("int") + 1,
    )
    return F.when(n < 12, small).otherwise(large)


# ln(n!) - (n ln n - n + ln(2 pi n) / 2) for n below 12, with 1 for n under the root where n is 0.
STIRLING_GAP = [-0.5 * math.log(2 * math.pi)] + [
    math.log(math.factorial(n)) - (n * math.log(n) - n + 0.5 * math.log(2 * math.pi * n)) for n in range(1, 12)
]


def stirling_gap(n: Column) -> Column:
    """What Stirling's formula lacks of ln(n!); small, so sums of it do not cancel."""
    x = F.greatest(n.cast("double"), F.lit(12.0))
    series = reduce(lambda a, b: a + b, [F.lit(c) / F.pow(x, F.lit(float(2 * k + 1))) for k, c in enumerate(STIRLING)])
    small = F.element_at(F.array(*[F.lit(v) for v in STIRLING_GAP]), F.least(n, F.lit(11)).cast("int") + 1)
    return F.when(n < 12, small).otherwise(series)


def deviance(x: Column, mean: Column, gap: Column) -> Column:
    """``x ln(x / mean) - (x - mean)`` for ``gap = x - mean`` known without cancellation; 0 or more."""
    near = F.abs(gap) < 0.1 * (x + mean)
    # In v = gap / (x + mean): gap * v + 2 x (v^3 / 3 + v^5 / 5 + ..), whose terms do not cancel.
    v = gap / (x + mean)
    power, series = v, F.lit(0.0)
    for k in range(1, 10):
        power = power * v * v
        series = series + power / F.lit(float(2 * k + 1))
    far = F.when(x > 0, x * F.log(F.when(x > 0, x).otherwise(1.0) / mean)).otherwise(0.0) - gap
    return F.when(x + mean == 0, F.lit(0.0)).when(near, gap * v + 2 * x * series).otherwise(far)
