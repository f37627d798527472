"""Spatial partitions over the cell grid with an overlap wide enough to see every neighbour.

Partition ids follow from the cell position alone, so copies are made by a projection and an explode,
without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densegrid.functions.geometry import number
from densegrid.operators.grid import Grid, linear


def halo_radius(n_features: int, rho: float = 0.0) -> int:
    """Overlap in cells that covers a distance of ``eps * (1 + rho)``."""
    return math.ceil((1 + rho) * math.sqrt(n_features))


def _step(grid: Grid, parts: list[int], k: int) -> float:
    return (grid.n[k] - 1) / parts[k]


def partition_edges(spark: SparkSession, grid: Grid, parts: list[int]) -> DataFrame:
    """Edges of the partitions in cell units: ``(dim, i, edge)``."""
    sizes = spark.createDataFrame(
        [(k, parts[k], grid.n[k] - 1) for k in range(len(parts))], "dim int, parts long, top long"
    )
    return sizes.select(
        "dim", "parts", "top", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts"))).alias("i")
    ).select("dim", "i", (F.col("i") * (F.col("top").cast("double") / F.col("parts"))).alias("edge"))


def home_index(grid: Grid, parts: list[int], k: int, cell: str) -> str:
    """SQL text of the partition of a cell in dimension ``k``."""
    if grid.n[k] == 1:
        return "0L"
    return f"least({parts[k] - 1}L, greatest(0L, floor({cell} / {number(_step(grid, parts, k))})))"


def home_partition(located: DataFrame, grid: Grid, parts: list[int]) -> DataFrame:
    """Add ``home``, the partition whose own range holds the cell."""
    own = [home_index(grid, parts, k, c) for k, c in enumerate(grid.cells)]
    return located.select("*", F.expr(linear(own, parts)).alias("home"))


def replicate(located: DataFrame, grid: Grid, parts: list[int], rho: float = 0.0) -> DataFrame:
    """One row per partition that holds the cell within its range plus the overlap: ``paid``, ``is_home``."""
    reach = halo_radius(len(grid.n), rho)
    df = home_partition(located, grid, parts)
    names = [f"_p{k}" for k in range(len(parts))]
    for k, (c, p) in enumerate(zip(grid.cells, names)):
        last = f"{parts[k] - 1}L"
        if grid.n[k] == 1:
            df = df.select("*", F.expr(f"explode(sequence(0L, {last}))").alias(p))
            continue
        step = number(_step(grid, parts, k))
        low = f"greatest(0L, floor(({c} - {reach}) / {step}) - 2)"
        high = f"least({last}, floor(({c} + {reach}) / {step}) + 1)"
        df = df.select("*", F.expr(f"explode(sequence({low}, {high}))").alias(p)).filter(
            f"{c} >= {p} * {step} - {reach} AND {c} <= ({p} + 1) * {step} + {reach}"
        )
    paid = linear(names, parts)
    return df.select(
        "*", F.expr(paid).alias("paid"), F.expr(f"CASE WHEN {paid} = home THEN 1 ELSE 0 END").alias("is_home")
    ).drop("home", *names)


def partition_load(copies: DataFrame) -> DataFrame:
    """Rows, cells and home rows per partition. Rows are first reduced per cell, so no partition is hot."""
    per_cell = copies.groupBy("paid", "gid").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("is_home").alias("home_rows")
    )
    return per_cell.groupBy("paid").agg(
        F.sum("rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_cells"),
        F.sum("home_rows").alias("n_home_rows"),
    )


def merge_flags(flags: DataFrame) -> DataFrame:
    """One flag per point from the flags of its copies: core when core in any partition."""
    return flags.groupBy("gid", "point_id").agg(F.max("core_flag").alias("core_flag"))
