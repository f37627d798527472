"""Gaussian blobs: one row per id of a given table, scattered around given centers.

The offsets come from a hash of id, dimension and seed, so a row is the same however the ids are
partitioned, and repeats exactly on a retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX_DIGITS = 13
UNIT = float(16**HEX_DIGITS)


def _uniform(point_id: Column, tag: str) -> Column:
    """Number in (0, 1) from a hash."""
    digest = F.md5(F.concat_ws("-", point_id.cast("string"), F.lit(tag)).cast("binary"))
    whole = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("bigint")
    return (whole.cast("double") + 0.5) / F.lit(UNIT)


def blobs(ids: DataFrame, centers: DataFrame, d: int, std: float = 1.0, seed: int = 42) -> DataFrame:
    """``(point_id, center, x0..)`` for ``ids(point_id)`` and ``centers(center, m0..)``.

    Centers are numbered 0, 1, .. and take turns along the ids, so blobs have equal sizes.
    """
    n_centers = centers.count()
    placed = ids.select("point_id", F.pmod(F.col("point_id"), F.lit(n_centers)).cast("int").alias("center"))
    placed = placed.join(centers, "center")
    out = []
    for k in range(d):
        u = _uniform(F.col("point_id"), f"{k}-a-{seed}")
        v = _uniform(F.col("point_id"), f"{k}-b-{seed}")
        offset = F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)
        out.append((F.col(f"m{k}") + std * offset).alias(f"x{k}"))
    return placed.select("point_id", "center", *out)
