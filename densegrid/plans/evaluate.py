"""Comparison of an approximate with an exact labeling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegrid.operators import metrics
from densegrid.operators.grid import checked_points
from densegrid.operators.labels import fill_labels
from densegrid.operators.silhouette import silhouette
from densegrid.plans.approx import approx_dbscan
from densegrid.plans.exact import exact_dbscan
from densegrid.runtime import stage


def compare_labels(
    points: DataFrame, features: list[str], eps: float, min_pts: int, invalid: str = "raise", stable: bool = False, **options
) -> DataFrame:
    """Every point with its coordinates, the approximate and the exact cluster, as a staged table.

    Points are checked (``invalid``) and, unless ``stable``, staged once; both runs and the labels read the same rows.
    Features keep their names.
    """
    checked, plain = checked_points(points, features, invalid)
    if not stable:
        checked = stage(checked, "points")
    approx = fill_labels(checked, approx_dbscan(checked, plain, eps, min_pts, stable=True, **options))
    exact = exact_dbscan(checked, plain, eps, min_pts, stable=True)
    joined = (
        checked.select("point_id", *[F.col(p).alias(f) for p, f in zip(plain, features)])
        .join(approx.select("point_id", "cluster_id", "is_noise"), "point_id")
        .join(exact.select("point_id", exact["cluster_id"].alias("exact_cluster")), "point_id")
    )
    return stage(joined, "compared")


def evaluate(df: DataFrame, features: list[str], true_col: str, pred_col: str) -> DataFrame:
    """One row ``(ari, ami, silhouette)``; the silhouette describes ``pred_col``."""
    table = stage(metrics.contingency(df, true_col, pred_col), "contingency")
    return metrics.side_by_side(
        {
            "ari": metrics.ari(table),
            "ami": metrics.ami(table),
            "silhouette": silhouette(df, features, pred_col),
        }
    )
