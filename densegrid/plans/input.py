"""From points to located points and to overlapping partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegrid.operators.grid import Grid, checked_points
from densegrid.operators.halo import replicate
from densegrid.runtime import stage


def locate(
    points: DataFrame, features: list[str], eps: float, kind: str = "stretched", invalid: str = "raise", stable: bool = False
) -> tuple[DataFrame, Grid]:
    """Points with their cell ``c0..`` and ``gid``, and the grid; for large grids a cell is named by its smallest point."""
    points, features = checked_points(points, features, invalid)
    if not stable:
        points = stage(points, "points")
    grid = Grid.fit(points, features, eps, kind)
    if grid.fits:
        return grid.locate(points).select("*", F.expr(grid.gid(grid.cells)).alias("gid")), grid
    return grid.locate(grid.attach_gid(points, "point_id")), grid


def halo(
    points: DataFrame, features: list[str], eps: float, parts: list[int], rho: float = 0.0, kind: str = "stretched",
    invalid: str = "raise", stable: bool = False,
) -> DataFrame:
    """Located points, one row per partition that holds them in its range or overlap: ``paid``, ``is_home``."""
    placed, grid = locate(points, features, eps, kind, invalid, stable)
    return replicate(placed, grid, parts, rho)
