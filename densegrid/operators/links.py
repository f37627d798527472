"""Closest distance between neighbouring cells, without comparing all their points.

Every cell is split into boxes; for a pair of boxes of two cells the distance of the bounding boxes is a
lower limit and the distance of one point of each an upper limit. Pairs whose lower limit reaches the best
upper limit of their cell pair, or the radius, are dropped. Pairs with few points are compared directly,
the rest are split and go to the next round, so a cell of any size costs work along its surface only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densegrid.functions.geometry import (
    SLACK,
    box_distance,
    cell_index,
    coin,
    distance,
    number,
    prefixed,
    touched_cells,
)
from densegrid.operators.neighbors import binned_dims, search_side
from densegrid.runtime import HOT_ROWS, LEAF_PAIRS, hot_join, setting, stage, stage_told, tiled_join

SPLIT_DIMS = 4


def box_widths(n: int, side: float, level: int) -> list[float]:
    """Width of a box per dimension; up to four dimensions are halved per level, in turn."""
    groups = -(-n // SPLIT_DIMS)
    return [side / 2.0 ** (level // groups + (1 if k // SPLIT_DIMS < level % groups else 0)) for k in range(n)]


def box_key(features: list[str], side: float, level: int) -> list[Column]:
    """Box index per dimension."""
    return [F.expr(cell_index(f, width)) for f, width in zip(features, box_widths(len(features), side, level))]


def _boxes(pts: DataFrame, features: list[str], key: list[str], extra: list[str] = []) -> DataFrame:
    return pts.groupBy("gid", *key, *extra).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min_by(f, "uid").alias(f"rep_{f}") for f in features],
        *[F.min(f).alias(f"lo_{f}") for f in features],
        *[F.max(f).alias(f"hi_{f}") for f in features],
    )


def _rename(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*prefixed(prefix, df.columns))


def _limits(pairs: DataFrame, features: list[str], key: list[str]) -> DataFrame:
    """Reduce a pair of boxes to its keys, sizes and distance limits."""
    def side(p: str, what: str) -> list[str]:
        return [f"{p}{what}_{f}" for f in features]

    return pairs.select(
        F.col("a_gid").alias("src"),
        F.col("b_gid").alias("dst"),
        *prefixed("a_", key),
        *prefixed("b_", key),
        "a_n",
        "b_n",
        box_distance(side("a_", "lo"), side("a_", "hi"), side("b_", "lo"), side("b_", "hi")).alias("lb"),
        distance(side("a_", "rep"), side("b_", "rep")).alias("ub"),
        *([F.col("best")] if "best" in pairs.columns else [F.lit(None).cast("double").alias("best")]),
    )


def _first_pairs(boxes: DataFrame, features: list[str], key: list[str], side: float, radius: float,
                 dims: list[int], rows: int | None = None) -> DataFrame:
    """Pairs of boxes of different cells that may hold points within the radius."""
    reach = radius * (1 + SLACK)
    extent = side * (1 + SLACK)
    width = 2 * reach
    a, b = _rename(boxes, "a_"), _rename(boxes, "b_")
    near_keys = [f"_k{k}" for k in dims]
    a = a.select("*", *[F.expr(cell_index(f"a_lo_{features[k]}", width)).alias(f"_k{k}") for k in dims])
    for k in dims:
        low = f"b_lo_{features[k]} - {number(reach + extent)}"
        high = f"b_hi_{features[k]} + {number(reach)}"
        b = b.select("*", touched_cells(low, high, width).alias(f"_k{k}"))
    pairs = tiled_join(a, b, near_keys, (rows, None if rows is None else rows * 3 ** len(dims))).filter(F.col("a_gid") < F.col("b_gid"))
    return _limits(pairs, features, key).filter(F.col("lb") <= radius)


def closest_between_cells(
    pts: DataFrame,
    features: list[str],
    radius: float,
    cell_scale: float,
    settle: float | None = None,
    rows: int | None = None,
) -> DataFrame:
    """``(src, dst, min_dist)`` for every pair ``src < dst`` of cells with points within ``radius``.

    ``pts`` is a staged table of distinct points with ``uid`` and their cell ``gid``; ``cell_scale`` is the ``eps`` of
    the grid; ``rows`` is an upper limit of the row count, when known. With ``settle``, a pair counts as decided as soon as some distance is at most ``settle``;
    ``min_dist`` is then only an upper limit for those pairs.
    """
    leaf = setting(pts.sparkSession, LEAF_PAIRS)
    side = search_side(cell_scale, len(features))
    dims = binned_dims(pts, features)
    key = prefixed("_q", [str(k) for k in range(len(features))])
    both = ["a_gid", *prefixed("a_", key)], ["b_gid", *prefixed("b_", key)]

    def at_level(level: int, key_names: list[str]) -> DataFrame:
        return pts.select(
            "gid", *[c.alias(n) for c, n in zip(box_key(features, side, level), key_names)], "uid", *features
        )

    crowded = (pts.count() if rows is None else rows) > setting(pts.sparkSession, HOT_ROWS)
    boxes = _boxes(at_level(0, key), features, key)
    if crowded:
        boxes = stage(boxes, "boxes")
    largest_pair = F.max(F.col("a_n") * F.col("b_n"))
    pairs, told = stage_told(_first_pairs(boxes, features, key, side, radius, dims, rows), "pairs", largest=largest_pair)
    found: list[DataFrame] = []
    level = 0
    while True:
        best = pairs.groupBy("src", "dst").agg(F.least(F.min("ub"), F.min("best")).alias("best"))
        found.append(best.filter(F.col("best") <= radius).select("src", "dst", F.col("best").alias("min_dist")))
        n_pairs, largest = told["rows"], told["largest"]
        open_pairs = hot_join(pairs.drop("best"), best, ["src", "dst"], rows=n_pairs).filter(
            (F.col("lb") < F.col("best")) & (F.col("lb") <= radius)
        )
        if settle is not None:
            open_pairs = open_pairs.filter(F.col("best") > settle)
        size = F.col("a_n") * F.col("b_n")

        small = open_pairs.filter((size > 1) & (size <= leaf)).select(
            F.col("src").alias("a_gid"), F.col("dst").alias("b_gid"), *both[0][1:], *both[1][1:]
        )
        members = at_level(level, key)
        if level > 0 or crowded:
            members = hot_join(members, boxes.filter(F.col("n") <= leaf).select("gid", *key), ["gid", *key], "left_semi")
        direct = (
            small.join(_rename(members, "a_"), both[0])
            .join(_rename(members, "b_"), both[1])
            .groupBy("a_gid", "b_gid")
            .agg(F.min(distance(prefixed("a_", features), prefixed("b_", features))).alias("min_dist"))
            .filter(F.col("min_dist") <= radius)
            .select(F.col("a_gid").alias("src"), F.col("b_gid").alias("dst"), "min_dist")
        )
        found.append(direct)

        if (largest or 0) <= leaf:
            break
        deep, deep_told = stage_told(open_pairs.filter(size > leaf), "deep")
        if not deep_told["rows"]:
            break

        # Children of the boxes still open: points of other boxes leave here.
        level += 1
        parents = prefixed("_p", [str(k) for k in range(len(features))])
        alive = (
            deep.select(F.col("src").alias("gid"), *[F.col(a).alias(p) for a, p in zip(both[0][1:], parents)])
            .union(deep.select(F.col("dst").alias("gid"), *[F.col(b).alias(p) for b, p in zip(both[1][1:], parents)]))
            .distinct()
        )
        old = [c.alias(p) for c, p in zip(box_key(features, side, level - 1), parents)]
        new = [c.alias(q) for c, q in zip(box_key(features, side, level), key)]
        alive = stage(alive, "alive")
        kept = hot_join(pts.select("gid", "uid", *features, *old, *new), alive, ["gid", *parents], "left_semi")
        boxes = stage(_boxes(kept, features, key, parents), "boxes")
        a, b = _rename(boxes, "a_"), _rename(boxes, "b_")
        up = deep.select(
            F.col("src").alias("a_gid"), F.col("dst").alias("b_gid"), "best",
            *[F.col(x).alias("a_" + p) for x, p in zip(both[0][1:], parents)],
            *[F.col(x).alias("b_" + p) for x, p in zip(both[1][1:], parents)],
        )
        step = up.join(a, ["a_gid", *prefixed("a_", parents)]).join(b, ["b_gid", *prefixed("b_", parents)])
        limited = _limits(step, features, key)
        open_now = limited.filter((F.col("lb") <= radius) & (F.col("lb") < F.col("best")))
        pairs, told = stage_told(open_now, "pairs", largest=largest_pair)

    return reduce(DataFrame.unionByName, found).groupBy("src", "dst").agg(F.min("min_dist").alias("min_dist"))


def link_cells(
    pts: DataFrame,
    features: list[str],
    eps: float,
    rho: float = 0.0,
    policy: str = "never",
    seed: int = 0,
    rows: int | None = None,
) -> DataFrame:
    """Neighbour cells ``(src, dst)``: closest points within ``eps``, or in the band up to
    ``eps * (1 + rho)`` when ``policy`` is ``always`` or the seeded coin says so."""
    if policy not in ("never", "always", "seeded"):
        raise ValueError(f"unknown rho policy {policy!r}")
    outer = eps if policy == "never" else eps * (1 + rho)
    settle = outer if policy == "always" else eps
    found = closest_between_cells(pts, features, outer, eps, settle, rows)
    if policy == "seeded":
        found = found.filter((F.col("min_dist") <= eps) | coin(F.col("src"), F.col("dst"), seed))
    return found.select("src", "dst")
