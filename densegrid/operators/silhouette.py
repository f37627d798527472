"""Mean silhouette with Euclidean distances.

1. Space is split into boxes of at most ``BOX_ROWS`` distinct points. For a box, the mean distance to a
   label is at least the distance to the centroid of the label, and at most that plus the radius of the
   label. Labels that cannot be among the nearest two of a box are dropped, which loses nothing.
2. For the labels left, distances are added up point by point, exactly, at every size of data: a label's
   points are dealt into tiles of about ``TILE_ROWS``, neighbouring boxes into groups of ``TILE_BOXES``, and one key
   holds one tile and one group, so no task grows with a label. A tile travels only to the groups that ask for it, and
   its distances are taken in blocks of arrays. A mean over all pairs of a label stays quadratic in its points.

``theta > 0`` asks for the other mode, ``grouped``: a group of more than ``FEW_ROWS`` points that is small
against its distance (radius at most ``theta`` times the gap) enters as weight, centroid and covariance, the
second-order expansion of the distance sum. Other groups of up to ``NEAR_ROWS`` points are compared point by
point, and larger ones are split further. That result carries its mode and a bound of its error.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegrid.functions.geometry import z_order
from densegrid.operators.links import box_key, box_widths
from densegrid.runtime import hot_join, number_rows, stage, stage_told

BOX_ROWS = 1024
TILE_ROWS = 32768
TILE_BOXES = 64
#: Points and sources of one step inside a tile.
BLOCK = (128, 1024)
MOST_TASKS = 4096
NEAR_ROWS = 128
FEW_ROWS = 8
GROUPS = 8
HALVINGS = 2
SAFE = 1 - 1e-9


def _keyed(df: DataFrame, features: list[str], side: float, level: int) -> DataFrame:
    """Add the box key of a level and of the level above; level 0 is one box, each next one is a quarter wide."""

    def key(at: int) -> list:
        return [F.lit(0).cast("bigint")] * len(features) if at <= 0 else box_key(features, side, HALVINGS * (at - 1))

    names = range(len(features))
    return df.select(
        "*",
        *[c.alias(f"k{i}") for i, c in zip(names, key(level))],
        *[c.alias(f"up{i}") for i, c in zip(names, key(level - 1))],
    )


def _root_of_squares(terms: list[str]) -> str:
    return "sqrt(" + " + ".join(f"({t}) * ({t})" for t in terms) + ")"


class _Space:
    """Names shared by the two steps."""

    def __init__(self, features: list[str], low: list[float], side: float):
        self.features = features
        self.low = low
        self.side = side
        self.key = [f"k{i}" for i in range(len(features))]
        self.up = [f"up{i}" for i in range(len(features))]
        self.cov = [f"v_{f}_{g}" for i, f in enumerate(features) for g in features[i:]]

    def box(self, prefix: str) -> list:
        return [F.min(f).alias(f"{prefix}lo_{f}") for f in self.features] + [
            F.max(f).alias(f"{prefix}hi_{f}") for f in self.features
        ]

    def names(self, *prefixes: str) -> list[str]:
        return [p + f for p in prefixes for f in self.features]

    def gap_to_centroid(self) -> str:
        """Smallest distance of a target box to a centroid."""
        return _root_of_squares([f"greatest(0D, tlo_{f} - c_{f}, c_{f} - thi_{f})" for f in self.features])


def _moments(space: _Space, level: int) -> list:
    """Weight, centroid and covariance of a group; sums are taken from the corner of its box, so nothing cancels."""
    widths = [0.0] * len(space.features) if level <= 0 else box_widths(len(space.features), space.side, HALVINGS * (level - 1))
    corner = {f: F.col(k) * F.lit(w) for f, k, w in zip(space.features, space.key, widths)}
    own = {f: F.col(f) - corner[f] for f in space.features}
    mean = {f: F.sum(own[f] * F.col("mult")) / F.sum("mult") for f in space.features}
    out = [F.sum("mult").cast("double").alias("w")] + [(corner[f] + mean[f]).alias(f"c_{f}") for f in space.features]
    for i, f in enumerate(space.features):
        for g in space.features[i:]:
            raw = F.sum(own[f] * own[g] * F.col("mult")) / F.sum("mult")
            out.append((raw - mean[f] * mean[g]).alias(f"v_{f}_{g}"))
    return out


def _target_boxes(sites: DataFrame, n_sites: int, space: _Space) -> tuple[DataFrame, DataFrame]:
    """Boxes of points with the labels that matter to them.

    Returns ``members`` (every site with its box ``tid``) and ``pairs`` (box, label, label size).
    """
    stats = sites.groupBy("label").agg(
        *[(F.sum(F.col(f) * F.col("mult")) / F.sum("mult")).alias(f"c_{f}") for f in space.features],
        *space.box(""),
        F.sum("mult").alias("n_label"),
    )
    reach = _root_of_squares([f"greatest(hi_{f} - c_{f}, c_{f} - lo_{f})" for f in space.features])
    labels = stage(
        stats.select("label", "n_label", *space.names("c_"), F.expr(reach).alias("radius")), "label_stats"
    )
    wanted = labels.select("*", *[F.lit(0).cast("bigint").alias(u) for u in space.up])
    spot = F.pmod(F.xxhash64("label"), F.lit(GROUPS))
    far_corner = _root_of_squares([f"greatest(thi_{f} - c_{f}, c_{f} - tlo_{f})" for f in space.features])

    members, pairs = [], []
    rest, level = sites, 0
    while True:
        keyed = _keyed(rest, space.features, space.side, level)
        one_spot = " AND ".join(f"tlo_{f} = thi_{f}" for f in space.features)
        done = f"rows <= {BOX_ROWS} OR ({one_spot})"
        boxes, told = stage_told(
            keyed.groupBy(*space.key, *space.up).agg(
                F.count(F.lit(1)).alias("rows"), F.min("uid").alias("tid"), *space.box("t")
            ),
            "targets",
            growing=F.count_if(F.expr(f"NOT ({done})")),
        )
        offers = hot_join(wanted, boxes, space.up).select(
            *space.key, "tid", "rows", "label", "n_label", "radius", *space.names("c_", "tlo_", "thi_"),
            (F.expr(space.gap_to_centroid()) * SAFE).alias("least"),
            (F.expr(far_corner) + F.col("radius")).alias("most"),
        )
        offers = stage(offers, "offers")
        # The second smallest of the group minima is never below the second smallest of all.
        minima = offers.groupBy("tid").agg(
            *[F.min(F.when(spot == i, F.col("most"))).alias(f"g{i}") for i in range(GROUPS)]
        )
        ranked = F.array_sort(F.array_compact(F.array(*[F.col(f"g{i}") for i in range(GROUPS)])))
        second = minima.select("tid", F.get(ranked, F.lit(1)).alias("second"))
        kept = hot_join(offers, second, ["tid"]).filter(F.col("second").isNull() | (F.col("least") <= F.col("second")))

        inside = keyed.drop(*space.up)
        finished = boxes.filter(done).select(*space.key, "tid", *space.names("tlo_", "thi_"))
        mine = hot_join(inside, finished.select(*space.key, "tid"), space.key, rows=n_sites).drop(*space.key)
        members.append(mine)
        pairs.append(kept.filter(done).select("tid", "label", "n_label", *space.names("tlo_", "thi_")))
        if not told["growing"]:
            break
        growing = boxes.filter(f"NOT ({done})").select(*space.key)
        rest = stage(hot_join(inside, growing, space.key, "left_semi", rows=n_sites).drop(*space.key), "rest")
        wanted = stage(
            kept.filter(f"NOT ({done})").select(
                *[F.col(k).alias(u) for k, u in zip(space.key, space.up)],
                "label", "n_label", "radius", *space.names("c_"),
            ),
            "wanted",
        )
        level += 1

    all_members = stage(reduce(DataFrame.unionByName, members), "members")
    # Every box also needs the labels of its own points.
    own = all_members.groupBy("tid", "label").agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    own = hot_join(own, labels.select("label", "n_label"), ["label"])
    extents = all_members.groupBy("tid").agg(*space.box("t"))
    own = own.join(extents, "tid").select("tid", "label", "n_label", *space.names("tlo_", "thi_"))
    offered = reduce(DataFrame.unionByName, pairs)
    return all_members, stage(offered.unionByName(own).distinct(), "label_pairs")


def _sources(sites: DataFrame, pairs: DataFrame, space: _Space, theta: float) -> DataFrame:
    """What each box is compared with: single points, or groups as weight, centroid and covariance."""
    zero = [F.lit(0.0).alias(v) for v in space.cov]
    radius = _root_of_squares([f"greatest(hi_{f} - c_{f}, c_{f} - lo_{f})" for f in space.features])
    carried = ["tid", "label", "n_label", *space.names("tlo_", "thi_")]
    open_pairs = pairs.select(*carried, *[F.lit(0).cast("bigint").alias(u) for u in space.up])
    rest, level, out = sites, 0, []
    columns = ["tid", "label", "n_label", "w", *space.names("c_"), *space.cov]
    while True:
        keyed = _keyed(rest, space.features, space.side, level)
        groups = stage(
            keyed.groupBy("label", *space.key, *space.up).agg(
                F.count(F.lit(1)).alias("rows"), *space.box(""), *_moments(space, level)
            ),
            "groups",
        )
        met = hot_join(open_pairs, groups, ["label", *space.up])
        state = (
            f"CASE WHEN rows > {FEW_ROWS} AND {radius} <= {theta} * {space.gap_to_centroid()} THEN 1 "
            f"WHEN rows <= {NEAR_ROWS} THEN 0 ELSE 2 END"
        )
        stated = met.select(*carried, *space.key, "w", *space.names("c_"), *space.cov, F.expr(state).alias("state"))
        met, told = stage_told(stated, "met", split=F.count_if(F.col("state") == 2))
        out.append(met.filter("state = 1").select(*columns))
        single = keyed.select(
            "label", *space.key, F.col("mult").cast("double").alias("w"),
            *[F.col(f).alias(f"c_{f}") for f in space.features], *zero,
        )
        small = groups.filter(f"rows <= {NEAR_ROWS}").select("label", *space.key)
        single = single.join(small, ["label", *space.key], "left_semi")
        near = met.filter("state = 0").select("tid", "label", "n_label", *space.key)
        out.append(near.join(single, ["label", *space.key]).select(*columns))
        split = met.filter("state = 2")
        if not told["split"]:
            break
        open_pairs = split.select(*carried, *[F.col(k).alias(u) for k, u in zip(space.key, space.up)])
        growing = split.select("label", *space.key).distinct()
        rest = stage(
            hot_join(keyed.drop(*space.up), growing, ["label", *space.key], "left_semi").drop(*space.key), "rest"
        )
        level += 1
    return reduce(DataFrame.unionByName, out)


def _routed(sites: DataFrame, pairs: DataFrame, space: _Space) -> tuple[DataFrame, DataFrame]:
    """What meets what: ``wanted`` (box, label, tile, group of the box) and the ``sources`` with the groups they go to.

    A row of a label's tile is there once for every group with a box that asks for the label.
    """
    tiles = stage(sites.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("tiles")), "tiles")
    boxes = pairs.select("tid", *space.names("tlo_")).distinct()
    along = boxes.select("tid", z_order(space.names("tlo_"), space.low, space.side).alias("z"))
    grouped = number_rows(along, ["z", "tid"], "at").select("tid", F.floor(F.col("at") / TILE_BOXES).alias("group"))
    wanted = hot_join(pairs.select("tid", "label", "n_label"), tiles, ["label"]).join(grouped, "tid").select(
        "tid", F.col("label").alias("other"), "n_label", "group", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    )
    wanted = stage(wanted, "wanted")
    demand = stage(wanted.select("other", "tile", "group").distinct(), "demand")
    dealt = hot_join(sites, tiles, ["label"]).select(
        F.col("label").alias("other"), F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int").alias("tile"),
        F.col("mult").cast("double").alias("w"), *[F.col(f).alias(f"c_{f}") for f in space.features],
    )
    return wanted, dealt.join(demand, ["other", "tile"])


def _distances(d: int):
    def vectors(table: pa.Table) -> list[np.ndarray]:
        return list(table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, d).T.copy())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Points and a tile of sources -> the sum of distances of every point to the tile."""
        x, y, w = vectors(left), vectors(right), right.column("w").to_numpy()
        far = np.zeros(left.num_rows)
        for at in range(0, len(far), BLOCK[0]):
            for to in range(0, len(w), BLOCK[1]):
                rows, some = slice(at, at + BLOCK[0]), slice(to, to + BLOCK[1])
                total = None
                for a, b in zip(x, y):
                    gap = np.subtract.outer(a[rows], b[some])
                    gap *= gap
                    total = gap if total is None else np.add(total, gap, out=total)
                far[rows] += np.sqrt(total, out=total) @ w[some]
        return left.select(["uid", "label", "mult", "other", "n_label"]).append_column("far", pa.array(far))

    return run


def _exact_sums(sites: DataFrame, members: DataFrame, pairs: DataFrame, space: _Space) -> DataFrame:
    """``(uid, label, mult, other, n_label, far)``: the sum of distances of every point to every label it needs."""
    wanted, sources = _routed(sites, pairs, space)
    keys = ["other", "tile", "group"]
    tasks = max(1, min(MOST_TASKS, wanted.select(*keys).distinct().count()))
    kinds = {f.name: f.dataType.simpleString() for f in sites.schema.fields}
    asking = members.join(wanted, "tid").select(
        "uid", "label", "mult", "n_label", F.array(*space.features).alias("x"), *[F.col(k).alias(k) for k in keys]
    )
    met = sources.select(F.array(*space.names("c_")).alias("x"), "w", *[F.col(k).alias(k) for k in keys])
    # Few bytes, many comparisons: a task per key, not per amount of data.
    sums = asking.repartition(tasks, *keys).groupBy(*keys).cogroup(met.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(
        _distances(len(space.features)),
        f"uid {kinds['uid']}, label {kinds['label']}, mult bigint, other {kinds['label']}, n_label bigint, far double",
    )
    return sums.groupBy("uid", "label", "mult", "other", "n_label").agg(F.sum("far").alias("far"))


def _grouped_sums(sites: DataFrame, members: DataFrame, pairs: DataFrame, space: _Space, theta: float) -> DataFrame:
    """The same sums with far groups expanded to second order."""
    # Few bytes, many comparisons: spread the sources before they meet the points of their box.
    sources = _sources(sites, pairs, space, theta).withColumnRenamed("label", "other").repartition("tid")
    features = space.features
    gaps = [f"({f} - c_{f})" for f in features]
    squared = " + ".join(f"{g} * {g}" for g in gaps)
    spread = " + ".join(f"v_{f}_{f}" for f in features)
    along = " + ".join(
        f"{'' if i == j else '2 * '}v_{features[i]}_{features[j]} * {gaps[i]} * {gaps[j]}"
        for i in range(len(features)) for j in range(i, len(features))
    )
    far = f"CASE WHEN d2 = 0 THEN 0D ELSE w * (sqrt(d2) + 0.5D * (({spread}) - ({along}) / d2) / sqrt(d2)) END"
    met = members.join(sources, "tid").withColumn("d2", F.expr(squared))
    return met.groupBy("uid", "label", "mult", "other", "n_label").agg(F.sum(F.expr(far)).alias("far"))


def error_bound(theta: float) -> float:
    """Largest error of the grouped mode.

    The third derivative of a distance d is at most 3 / d^2, so the expansion of a group misses its sum by at most
    theta^3 / (2 (1 - theta)^2) of it; the quotient of two such sums by twice that.
    """
    part = theta**3 / (2 * (1 - theta) ** 2)
    return 2 * part / (1 - part)


def silhouette(df: DataFrame, features: list[str], label: str, theta: float = 0.0) -> DataFrame:
    """One row ``(silhouette)``; null when there are fewer than two labels. A point alone in its label is 0.

    Labels may be of any type; rows without one are left out. With ``theta`` (below 0.5) the row is
    ``(silhouette, mode, error_bound)`` of the grouped mode.
    """
    if not 0 <= theta < 0.5:
        raise ValueError("theta must be at least 0 and below 0.5")

    plain = [f if re.fullmatch(r"[A-Za-z]\w*", f) else f"feature_{k}" for k, f in enumerate(features)]
    df = df.select("point_id", F.col(f"`{label}`").alias("label"), *[F.col(f"`{f}`").alias(p) for f, p in zip(features, plain)])
    features = plain

    def result(found: DataFrame) -> DataFrame:
        if theta == 0:
            return found
        return found.select("silhouette", F.lit("grouped").alias("mode"), F.lit(error_bound(theta)).alias("error_bound"))

    sites = stage(
        df.filter(F.col("label").isNotNull()).groupBy("label", *features).agg(
            F.min("point_id").alias("uid"), F.count(F.lit(1)).alias("mult")
        ),
        "silhouette",
    )
    row = sites.agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("first"), F.max("label").alias("last"),
        *[F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f) for f in features],
    ).first()
    if row["n"] == 0 or row["first"] == row["last"]:
        return result(sites.agg(F.lit(None).cast("double").alias("silhouette")))
    if theta > 0:
        # Sums of squares are taken around the middle of the data, so that large coordinates do not cancel.
        middle = {f: (row[f]["lo"] + row[f]["hi"]) / 2 for f in features}
        sites = sites.select("label", *[(F.col(f) - F.lit(middle[f])).alias(f) for f in features], "uid", "mult")
    space = _Space(features, [row[f]["lo"] for f in features], max(row[f]["hi"] - row[f]["lo"] for f in features) or 1.0)

    members, pairs = _target_boxes(sites, row["n"], space)
    sums = _grouped_sums(sites, members, pairs, space, theta) if theta > 0 else _exact_sums(sites, members, pairs, space)
    own = F.col("other") == F.col("label")
    per_point = sums.groupBy("uid", "label", "mult").agg(
        F.max(F.when(own, F.col("n_label"))).alias("size"),
        F.max(F.when(own & (F.col("n_label") > 1), F.col("far") / (F.col("n_label") - 1))).alias("a"),
        F.min(F.when(~own, F.col("far") / F.col("n_label"))).alias("b"),
    )
    widest = F.greatest("a", "b")
    score = F.when((F.col("size") == 1) | (widest == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / widest)
    return result(per_point.agg((F.sum(F.col("mult") * score) / F.sum("mult")).alias("silhouette")))
