"""Label tables: missing points, dense renumbering, members, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegrid.runtime import hot_join, number_rows, stage


def dense_labels(df: DataFrame, label: str, order: str = "point_id") -> DataFrame:
    """Replace ``label`` by 0, 1, .. in the order in which values first appear along ``order``.

    ``df`` should be cheap to scan twice (a staged table).
    """
    first = df.groupBy(label).agg(F.min(order).alias("_first"))
    codes = number_rows(first, ["_first"], "_code").select(label, "_code")
    return hot_join(df, codes, [label]).drop(label).withColumnRenamed("_code", label)


def fill_labels(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every point with its cluster, renumbered densely; noise is numbered too and marked ``is_noise``."""
    full = points.select("point_id").join(clusters.select("point_id", "cluster_id", "core_flag"), "point_id", "left")
    marked = full.select(
        "point_id",
        F.coalesce("cluster_id", F.lit(-1).cast("bigint")).alias("cluster_id"),
        F.coalesce("core_flag", F.lit(-1)).cast("int").alias("core_flag"),
        F.when(F.col("cluster_id").isNull(), 1).otherwise(0).cast("int").alias("is_noise"),
    )
    return dense_labels(stage(marked, "labels"), "cluster_id")


def members(clusters: DataFrame) -> DataFrame:
    """Cluster summary: size, core count, smallest, largest and summed point id."""
    return clusters.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum(F.when(F.col("core_flag") == 1, 1).otherwise(0)).cast("bigint").alias("n_core"),
        F.min("point_id").alias("first_point"),
        F.max("point_id").alias("last_point"),
        F.sum(F.col("point_id").cast("decimal(38,0)")).alias("sum_points"),
    )


def lookup(points: DataFrame, wanted: DataFrame, features: list[str]) -> DataFrame:
    """First point id at the coordinates of each wanted row."""
    first = points.groupBy(*features).agg(F.min("point_id").alias("found_id"))
    return hot_join(wanted, first, features)
