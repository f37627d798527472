"""Agreement of two labelings: contingency, adjusted Rand index, adjusted mutual information."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegrid.functions.special import deviance, stirling_gap

TILE_SIZES = 1024
CHUNK = 65536


def contingency(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """``(label_true, label_pred, n)`` for the pairs that occur."""
    return df.groupBy(F.col(true_col).alias("label_true"), F.col(pred_col).alias("label_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _sizes(table: DataFrame, side: str) -> DataFrame:
    return table.groupBy(side).agg(F.sum("n").alias("n"))


def side_by_side(named: dict[str, DataFrame]) -> DataFrame:
    """Put one-row, one-column tables next to one another without a join."""
    rows = [df.toDF("_value").select(F.lit(name).alias("_name"), "_value") for name, df in named.items()]
    table = reduce(DataFrame.union, rows)
    return table.agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in named])


def ari(table: DataFrame) -> DataFrame:
    """Adjusted Rand index of a contingency table, from sums of squared counts."""
    n = F.col("n").cast("double")
    sums = side_by_side(
        {
            "pairs": table.agg(F.sum(n * n)),
            "rows": _sizes(table, "label_true").agg(F.sum(n * n)),
            "cols": _sizes(table, "label_pred").agg(F.sum(n * n)),
            "total": table.agg(F.sum(n)),
        }
    )
    tp = F.col("pairs") - F.col("total")
    fp = F.col("cols") - F.col("pairs")
    fn = F.col("rows") - F.col("pairs")
    tn = F.col("total") * F.col("total") - tp - fp - fn - F.col("total")
    below = (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)
    value = F.when((fp == 0) & (fn == 0), F.lit(1.0)).otherwise(2 * (tp * tn - fn * fp) / below)
    return sums.select(value.alias("ari"))


def expected_information(table: DataFrame, total: int) -> DataFrame:
    """Expected mutual information of random labelings with the same sizes.

    Labels of one size behave alike, so sizes are counted first: there are at most sqrt(2 * total)
    distinct ones per side. Both sides are dealt into tiles of about ``TILE_SIZES``. Per pair of sizes the overlap
    runs over 40 deviations and 1000 more on both sides of its mean; beyond that the weight is below exp(-800) by the
    Chernoff bound of the hypergeometric distribution, which is 0 in double precision, so nothing is lost.

    Weights are taken in deviance form: the large logarithms of factorials cancel on paper, not in the sum. As the
    overlaps' gaps to their mean add up to 0, ``k ln(k / mean)`` may lose its gap too, so every term is positive.
    """
    big = F.lit(total).cast("bigint")
    left = _sizes(table, "label_true").groupBy(F.col("n").alias("a")).agg(F.count(F.lit(1)).alias("wa"))
    right = _sizes(table, "label_pred").groupBy(F.col("n").alias("b")).agg(F.count(F.lit(1)).alias("wb"))
    tiles = max(1, math.ceil(math.sqrt(2 * total) / TILE_SIZES))
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    left = left.withColumn("_ta", F.pmod(F.xxhash64("a"), F.lit(tiles)).cast("int")).withColumn("_tb", every)
    right = right.withColumn("_tb", F.pmod(F.xxhash64("b"), F.lit(tiles)).cast("int")).withColumn("_ta", every)
    a, b, k = F.col("a"), F.col("b"), F.col("k")
    # The mean overlap a * b / total as a whole number and a rest, so that k minus the mean is exact.
    product = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
    whole = F.expr(f"cast((cast(a as decimal(19,0)) * cast(b as decimal(19,0))) div {total}L as bigint)")
    rest = (product % F.lit(total).cast("decimal(19,0)")).cast("double") / total
    mean = F.col("whole") + F.col("rest")
    # All four cells of the two-by-two table are off their means by the same gap, so the smallest mean bounds it.
    spread = 40 * F.sqrt(F.least(mean, "m_a", "m_b", "m_0")) + 1000
    low = F.greatest(F.lit(0).cast("bigint"), a + b - big, F.floor(mean - spread).cast("bigint"))
    high = F.least(a, b, F.ceil(mean + spread).cast("bigint"))

    def one(n: Column) -> Column:
        return F.greatest(n, F.lit(1)).cast("double")

    # What does not depend on the overlap is computed once per pair of sizes.
    fixed = stirling_gap(a) + stirling_gap(b) + stirling_gap(big - a) + stirling_gap(big - b) - stirling_gap(big)
    fixed = fixed + 0.5 * F.log(one(a) * one(b) * one(big - a) * one(big - b) / (2 * math.pi * float(total)))
    x, y = a.cast("double"), b.cast("double")
    terms = (
        left.join(right, ["_ta", "_tb"])
        .select("a", "b", (F.col("wa") * F.col("wb")).alias("w"), whole.alias("whole"), rest.alias("rest"), fixed.alias("fixed"))
        .select("*", (x / total * (big - b)).alias("m_a"), (y / total * (big - a)).alias("m_b"),
                ((big - a) / float(total) * (big - b)).alias("m_0"))
        .select("*", low.alias("low"), high.alias("high"))
        .filter("low <= high")
        .withColumn("at", F.explode(F.sequence("low", "high", F.lit(CHUNK).cast("bigint"))))
        .withColumn("k", F.explode(F.sequence("at", F.least(F.col("high"), F.col("at") + CHUNK - 1))))
        .withColumn("gap", (F.col("k") - F.col("whole")) - F.col("rest"))
        .withColumn("own", deviance(k.cast("double"), mean, F.col("gap")))
    )
    cells = [k, a - k, b - k, big - a - b + k]
    other = [deviance(n.cast("double"), F.col(m), g * F.col("gap")) for n, m, g in zip(cells[1:], ("m_a", "m_b", "m_0"), (-1, -1, 1))]
    root = reduce(lambda u, v: u * v, [one(n) for n in cells])
    lacking = reduce(lambda u, v: u + v, [stirling_gap(n) for n in cells])
    weight = F.exp(F.col("fixed") - 0.5 * F.log(root) - lacking - F.col("own") - reduce(lambda u, v: u + v, other))
    return terms.agg(F.coalesce(F.sum(F.col("w") * F.col("own") * weight) / total, F.lit(0.0)).alias("emi"))


def ami(table: DataFrame) -> DataFrame:
    """Adjusted mutual information of a staged contingency table, arithmetic mean of the entropies."""
    total = table.agg(F.sum("n")).first()[0] or 0
    if total == 0:
        return table.agg(F.lit(1.0).alias("ami"))
    n = F.col("n").cast("double")
    rows, cols = _sizes(table, "label_true"), _sizes(table, "label_pred")
    sums = side_by_side(
        {
            "pairs": table.agg(F.sum(n * F.log(n))),
            "rows": rows.agg(F.sum(n * F.log(n))),
            "cols": cols.agg(F.sum(n * F.log(n))),
            "n_rows": rows.agg(F.count(F.lit(1)).cast("double")),
            "n_cols": cols.agg(F.count(F.lit(1)).cast("double")),
            "emi": expected_information(table, total),
        }
    )
    log_n = F.lit(math.log(total))
    hu, hv = log_n - F.col("rows") / total, log_n - F.col("cols") / total
    mi = log_n + (F.col("pairs") - F.col("rows") - F.col("cols")) / total
    raw = (hu + hv) / 2 - F.col("emi")
    tiny = F.lit(float(np.finfo(float).eps))
    below = F.when(raw < 0, F.least(raw, -tiny)).otherwise(F.greatest(raw, tiny))
    value = F.when((F.col("n_rows") == 1) & (F.col("n_cols") == 1), F.lit(1.0)).otherwise(
        (mi - F.col("emi")) / below
    )
    return sums.select(value.alias("ami"))
