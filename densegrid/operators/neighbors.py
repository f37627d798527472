"""Neighbour counts and core points within a radius, in linear work per point.

Points are first reduced to *sites*, one row per distinct coordinate vector with its multiplicity, so a
group of copies is one row. Sites are binned into search cells whose diagonal is below ``eps``: all
members of a cell are neighbours, so a site whose cell already holds enough other points is core without
any distance. What is left, the *probes*, number at most ``min_pts`` per search cell, whatever the size
of the cell, and only they are compared with the sites around them. Pairs are never materialised: the
join streams into a partial count per probe.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densegrid.functions.geometry import SLACK, cell_index, distance, number, prefixed, touched_cells
from densegrid.operators.balls import count_around
from densegrid.operators.grid import checked_points
from densegrid.runtime import HOT_ROWS, hot_cut, hot_join, setting, stage, stage_told, tiled_join

MAX_BINNED = 4


def distinct_sites(points: DataFrame, features: list[str], scope: list[str] = []) -> DataFrame:
    """One row per coordinate vector: ``uid`` (smallest point id) and ``mult`` (number of copies)."""
    return points.groupBy(*scope, *features).agg(
        F.min("point_id").alias("uid"), F.count(F.lit(1)).alias("mult")
    )


def search_side(eps: float, n_features: int) -> float:
    """Side of a cell whose members are all within ``eps`` of one another, rounding included."""
    return eps / math.sqrt(n_features) * (1 - SLACK)


def binned_dims(df: DataFrame, features: list[str]) -> list[int]:
    """Dimensions used as join keys: all when few, else the ones with the widest range."""
    if len(features) <= MAX_BINNED:
        return list(range(len(features)))
    row = df.agg(*[(F.max(f) - F.min(f)).alias(f) for f in features]).first()
    widest = sorted(range(len(features)), key=lambda k: -(row[features[k]] or 0.0))
    return sorted(widest[:MAX_BINNED])


def search_keys(df: DataFrame, features: list[str]) -> list[Callable[[list[str]], str]]:
    """Coordinates to search by, as SQL text of feature names: all dimensions when few.

    Beyond that the ones with the widest range among the dimensions and the distances to three corners of the data's
    box. A distance to a fixed point differs between two points by no more than they are apart, so it prunes in full
    space, and it has a wide range where single dimensions do not.
    """
    if len(features) <= MAX_BINNED:
        return [lambda names, k=k: names[k] for k in range(len(features))]
    row = df.agg(*[F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f) for f in features]).first()
    if row[features[0]]["lo"] is None:
        return [lambda names, k=k: names[k] for k in range(MAX_BINNED)]
    corners = [[row[f]["hi" if (k % 2, 1, 0)[c] else "lo"] for k, f in enumerate(features)] for c in range(3)]

    def to_corner(corner: list[float]) -> Callable[[list[str]], str]:
        return lambda names: "sqrt(" + " + ".join(f"({n} - {number(v)}) * ({n} - {number(v)})" for n, v in zip(names, corner)) + ")"

    distances = [to_corner(c) for c in corners]
    spans = df.agg(*[(F.max(F.expr(d(features))) - F.min(F.expr(d(features)))).alias(f"s{i}") for i, d in enumerate(distances)]).first()
    ways = [(spans[f"s{i}"], d) for i, d in enumerate(distances)]
    ways += [(row[f]["hi"] - row[f]["lo"], lambda names, k=k: names[k]) for k, f in enumerate(features)]
    return [way for _, way in sorted(ways, key=lambda w: -w[0])[:MAX_BINNED]]


def near(
    probe: DataFrame,
    data: DataFrame,
    probe_features: list[str],
    data_features: list[str],
    radius: float,
    by: list[Callable[[list[str]], str]],
    scope: list[tuple[str, str]] = [],
    rows: int | None = None,
) -> DataFrame:
    """Rows of ``probe`` joined with the rows of ``data`` within ``radius``, plus ``dist``.

    ``data`` is keyed by a coarse cell of twice the radius; every probe is sent to the cells its box of
    that radius touches, two per coordinate of ``by``. Coarse cells with too many rows on either side are cut into
    tiles of both sides. ``rows`` is an upper limit of the rows of either side, when known.
    """
    reach = radius * (1 + SLACK)
    width = 2 * reach
    keys = [f"_k{k}" for k in range(len(by))]
    for k, way in enumerate(by):
        x, r = way(probe_features), number(reach)
        probe = probe.select("*", touched_cells(f"{x} - {r}", f"{x} + {r}", width).alias(f"_k{k}"))
    data = data.select("*", *[F.expr(cell_index(way(data_features), width)).alias(f"_k{k}") for k, way in enumerate(by)])
    for i, (p, q) in enumerate(scope):
        probe = probe.withColumn(f"_s{i}", F.col(p))
        data = data.withColumnRenamed(q, f"_s{i}")
        keys.append(f"_s{i}")
    most = None if rows is None else rows * 2 ** len(by)
    pairs = tiled_join(probe, data, keys, (most, rows))
    gap = distance(probe_features, data_features)
    return pairs.withColumn("dist", gap).filter(F.col("dist") <= radius).drop(*keys)


def core_sites(
    points: DataFrame,
    features: list[str],
    eps: float,
    min_pts: int,
    rule: str = "strict",
    scope: list[str] = [],
    report: dict | None = None,
) -> DataFrame:
    """Sites with ``neighbors`` (counted up to ``min_pts``) and ``core_flag``, read from staged tables.

    ``rule="strict"`` counts points at other coordinates; ``rule="standard"`` counts every point, itself
    included. ``scope`` columns confine neighbours to equal values (the overlapping partitions). Beyond four dimensions
    the search goes by balls around pivots, and ``report`` receives how many pairs it looked at.
    """
    if rule not in ("strict", "standard"):
        raise ValueError(f"unknown rule {rule!r}")
    if eps <= 0:
        raise ValueError("eps must be positive")
    own: Column = F.col("mult") if rule == "strict" else F.lit(0).cast("bigint")
    enough = F.lit(min_pts).cast("bigint")
    fine = [f"_f{k}" for k in range(len(features))]
    side = search_side(eps, len(features))

    sites, told = stage_told(distinct_sites(points, features, scope), "sites")
    rows = told["rows"]
    keep = [*scope, *features, "uid", "mult"]
    celled = sites.select(*keep, *[F.expr(cell_index(f, side)).alias(c) for f, c in zip(features, fine)])
    counts = celled.groupBy(*scope, *fine).agg(F.sum("mult").alias("cell_n"))
    counted = hot_join(celled, counts, [*scope, *fine], rows=rows).withColumn("inside", F.col("cell_n") - own)
    counted = stage(counted.select(*keep, "inside"), "counted")

    seen = prefixed("q_", features)
    data = sites.select(
        *scope, *[F.col(f).alias(q) for f, q in zip(features, seen)], F.col("mult").alias("q_mult")
    )
    probes = counted.filter(F.col("inside") < enough).select(*keep)
    if len(features) > MAX_BINNED and not scope:
        found = count_around(sites, probes, features, eps, own + enough, rows, report)
        around = stage(probes.join(found, "uid").select(*keep, "around"), "around")
    else:
        by = search_keys(sites, features)
        pairs = near(probes, data, features, seen, eps, by, [(s, s) for s in scope], rows)
        around = stage(pairs.groupBy(*keep).agg(F.sum("q_mult").alias("around")), "around")
    thin = around.select(*keep, F.least(F.col("around") - own, enough).alias("neighbors"))

    dense = counted.filter(F.col("inside") >= enough).select(*keep, enough.alias("neighbors"))
    return dense.unionByName(thin).withColumn(
        "core_flag", F.when(F.col("neighbors") >= enough, 1).otherwise(0).cast("int")
    )


def to_points(
    points: DataFrame, sites: DataFrame, features: list[str], scope: list[str] = [], base: DataFrame | None = None
) -> DataFrame:
    """Give every point the columns of its site.

    A site with one member already carries the id of its only point; only copies need a join. ``base`` is
    a staged table with the ``mult`` of all sites, when ``sites`` itself is not cheap to scan.
    """
    base = sites if base is None else base
    keys = [*scope, *features]
    carried = [c for c in sites.columns if c not in ("uid", "mult", *keys)]
    alone = sites.filter("mult = 1").select(*keys, F.col("uid").alias("point_id"), *carried)
    largest, total = base.agg(F.max("mult"), F.sum("mult")).first()
    if (largest or 1) == 1:
        return alone
    copies = sites.filter("mult > 1").select(*keys, *carried)
    mine = points.select(*keys, "point_id")
    if len(features) > MAX_BINNED:
        # The checks of many features would be inferred anew for every one of as many join keys.
        mine = stage(mine, "mine")
    cut = hot_cut(setting(points.sparkSession, HOT_ROWS), total)
    if largest < cut:
        joined = mine.join(copies, keys)
    else:
        joined = hot_join(mine, copies, keys, hot=base.filter(F.col("mult") >= cut).select(*keys))
    return alone.unionByName(joined)


def neighbor_counts(
    points: DataFrame, features: list[str], eps: float, min_pts: int, rule: str = "strict", scope: list[str] = [],
    invalid: str = "raise", stable: bool = False, report: dict | None = None,
) -> DataFrame:
    """``(point_id, neighbors, core_flag)`` per point; the count stops at ``min_pts``.

    Points with missing or infinite features raise, or are left out with ``invalid="drop"``. Points are staged
    unless they are ``stable``, the same at every read.
    """
    points, features = checked_points(points, features, invalid, scope)
    if not stable:
        points = stage(points, "points")
    sites = core_sites(points, features, eps, min_pts, rule, scope, report)
    return to_points(points, sites, features, scope).select(*scope, "point_id", "neighbors", "core_flag")
