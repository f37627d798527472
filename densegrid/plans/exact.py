"""Exact density clustering, used as the baseline.

All core points of one search cell are within ``eps`` of one another, so cells can stand for their core
points in the connectivity graph; the result equals a run on all point pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegrid.functions.geometry import cell_index, prefixed
from densegrid.operators.balls import connecting_links, lowest_cluster
from densegrid.operators.components import connected_components
from densegrid.operators.grid import checked_points
from densegrid.operators.labels import dense_labels
from densegrid.operators.links import closest_between_cells
from densegrid.operators.neighbors import MAX_BINNED, core_sites, near, search_keys, search_side, to_points
from densegrid.runtime import hot_join, stage


def exact_dbscan(
    points: DataFrame, features: list[str], eps: float, min_pts: int, invalid: str = "raise", stable: bool = False
) -> DataFrame:
    """``(point_id, cluster_id, core_flag)`` for every point; noise is -1.

    A point counts itself. Clusters are numbered by their smallest core point id, and a border point takes
    the smallest number among the core points within ``eps``. ``invalid`` and ``stable`` as in
    :class:`~densegrid.plans.approx.ApproxClustering`.
    """
    points, features = checked_points(points, features, invalid)
    if not stable:
        points = stage(points, "points")
    sites = core_sites(points, features, eps, min_pts, rule="standard")
    fine = [f"_f{k}" for k in range(len(features))]
    side = search_side(eps, len(features))
    celled = sites.filter("core_flag = 1").select(
        "uid", "mult", *features, *[F.expr(cell_index(f, side)).alias(c) for f, c in zip(features, fine)]
    )
    names = celled.groupBy(*fine).agg(F.min("uid").alias("gid"))
    core = stage(hot_join(celled, names, fine).drop(*fine), "core")

    many = len(features) > MAX_BINNED
    if many:
        edges = connecting_links(core, features, eps)
    else:
        edges = closest_between_cells(core.select("gid", "uid", *features), features, eps, eps, settle=eps)
    vertices = core.select(F.col("gid").alias("id")).distinct()
    owners = connected_components(vertices, edges).select(
        F.col("id").alias("gid"), F.col("component").alias("cluster_id")
    )
    columns = ["uid", "mult", *features, "cluster_id", "core_flag"]
    clustered = hot_join(core, owners, ["gid"]).withColumn("core_flag", F.lit(1)).select(*columns)
    clustered = stage(clustered, "clustered")

    seen = prefixed("q_", features)
    keep = ["uid", "mult", *features]
    rest = sites.filter("core_flag = 0").select(*keep)
    data = clustered.select(*[F.col(f).alias(q) for f, q in zip(features, seen)], "cluster_id")
    if many:
        touched = rest.join(lowest_cluster(rest, clustered, features, eps), "uid")
    else:
        touched = near(rest, data, features, seen, eps, search_keys(sites, features)).groupBy(*keep).agg(F.min("cluster_id").alias("cluster_id"))
    border = touched.withColumn("core_flag", F.lit(0)).select(*columns)
    found = to_points(points, clustered.unionByName(border), features, base=sites)
    labeled = dense_labels(stage(found.select("point_id", "cluster_id", "core_flag"), "found"), "cluster_id", "cluster_id")
    return points.select("point_id").join(labeled, "point_id", "left").select(
        "point_id",
        F.coalesce("cluster_id", F.lit(-1).cast("bigint")).alias("cluster_id"),
        F.coalesce("core_flag", F.lit(0)).cast("int").alias("core_flag"),
    )
