"""Neighbours in many dimensions by balls around pivots.

Pivots are picked farthest-first from a bounded sample; every site belongs to the ball of its nearest pivot and keeps its
distances to all of them. A distance to a pivot differs between two sites by no more than they are apart, so a probe
meets, of a ball, only rows with a similar distance to its pivot, and only balls that reach it. Probes and rows of a ball
meet in tiles of both, whose distances are taken as matrix products; where rounding could decide, squares are summed in
the order of dimensions, as ``distance`` does.

Counts stop at a number, so balls are visited best-first: every probe is counted in its own ball, and only probes that
lack neighbours there go on, to the nearest balls in reach and then to the others. Connections need no list of all pairs:
what is connected within a ball, and then through a few points of every component, is not compared again; only points
outside the largest component meet the rest. The sample and the few points decide about speed alone; results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densegrid.functions.geometry import SLACK, number
from densegrid.operators.components import connected_components, extend_components
from densegrid.runtime import HOT_ROWS, hot_join, setting, stage, stage_told

#: Pivots at most, and sites that they are picked from.
PIVOTS, SAMPLE = 64, 4096
#: Rows of one side of a tile, and of the blocks it is worked off in.
TILE, PROBES, ROWS = 16_384, 256, 2048
#: Balls beside its own that a probe visits first, and points of a component that look for others first.
NEAREST, SCOUTS = 8, 64
#: Pairs that make a task of their own, and tasks at most.
TASK_PAIRS, MOST_TASKS = 20_000_000, 4096


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` rows, each the one farthest from those before; fewer when all rows are among them."""
    picked, gap = [0], np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(picked) < most and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, np.sqrt(((x - x[picked[-1]]) ** 2).sum(axis=1)))
    return x[picked]


def pick_pivots(sites: DataFrame, features: list[str], rows: int) -> np.ndarray:
    sample = sites.select("uid", *features).orderBy(F.xxhash64("uid")).limit(SAMPLE).collect()
    x = np.array([tuple(r)[1:] for r in sample], float).reshape(-1, len(features))
    return farthest_first(x, min(PIVOTS, math.ceil(math.sqrt(max(1, rows))))) if len(x) else x


def _vectors(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _measure(pivots: np.ndarray, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add the ball, the distance to its pivot and the distances to all pivots."""
        for batch in batches:
            x = _vectors(batch.column("x"), d)
            gaps = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
            ball = gaps.argmin(axis=1)
            cuts = pa.array(np.arange(len(x) + 1) * len(pivots), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ball.astype(np.int32)), pa.array(gaps[np.arange(len(x)), ball]),
                 pa.ListArray.from_arrays(cuts, pa.array(gaps.ravel()))],
                names=[*batch.schema.names, "ball", "ball_dist", "to_pivots"],
            )

    return run


def within(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Whether the distance of a row of ``x`` and a row of ``y`` is at most ``radius``, summed in the order of dimensions."""
    with np.errstate(all="ignore"):
        middle = y.mean(axis=0)
        a, b = x - middle, y - middle
        squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)
        over = squares - 2 * (a @ b.T) - radius * radius
        found = over <= 0
        p, q = np.nonzero(~(np.abs(over) > 2e-15 * (x.shape[1] + 8) * (squares + radius * radius)))
        total = np.zeros(len(p))
        for k in range(x.shape[1]):
            gap = x[p, k] - y[q, k]
            total += gap * gap
        found[p, q] = np.sqrt(total) <= radius
    return found


def _blocks(left: pa.Table, right: pa.Table, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of both sides that may be near: blocks of probes with the blocks of rows at a similar distance to the pivot."""
    gap, dist = left.column("gap").to_numpy(), right.column("ball_dist").to_numpy()
    probes, rows = np.argsort(gap), np.argsort(dist)
    dist, gap, at = dist[rows], gap[probes], 0
    while at < len(probes):
        end = min(at + PROBES, int(np.searchsorted(gap, gap[at] + reach / 8, "right")))
        some = probes[at:end]
        low = np.searchsorted(dist, gap[at] - reach)
        high = np.searchsorted(dist, gap[end - 1] + reach, "right")
        for to in range(low, high, ROWS):
            yield some, rows[to: min(high, to + ROWS)]
        at = end


class Balls:
    """Tables placed in balls around common pivots, and who meets whom within ``radius``."""

    def __init__(self, sites: DataFrame, features: list[str], radius: float, rows: int):
        self.features, self.radius, self.reach = features, radius, radius * (1 + SLACK)
        self.pivots = pick_pivots(sites, features, rows)
        self.tile = min(TILE, setting(sites.sparkSession, HOT_ROWS))

    def place(self, df: DataFrame, carried: list[str]) -> DataFrame:
        """The columns ``carried``, the vector ``x``, its ball and its distances to the pivots, as a staged table."""
        plain = df.select(*carried, F.array(*self.features).alias("x"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", ball int, ball_dist double, to_pivots array<double>"
        return stage(plain.mapInArrow(_measure(self.pivots, len(self.features)), schema), "balls")

    def sizes(self, data: DataFrame) -> dict[int, tuple]:
        """Rows and range of the distance to the pivot, by ball."""
        told = data.groupBy("ball").agg(F.count(F.lit(1)), F.min("ball_dist"), F.max("ball_dist"))
        return {r[0]: tuple(r)[1:] for r in told.collect()}

    def reached(self, probes: DataFrame, sizes: dict[int, tuple], first: int = 1, most: int | None = None, home: bool = False) -> DataFrame:
        """A row per probe and ball in reach of it, with ``gap``, from the ``first`` nearest on; without its own unless ``home``."""
        empty = (0, 1e308, -1e308)
        low, high = (f"array({', '.join(number(sizes.get(b, empty)[i]) for b in range(len(self.pivots)))})" for i in (1, 2))
        near = f"o.gap - {number(self.reach)} <= element_at({high}, o.ball + 1) AND o.gap + {number(self.reach)} >= element_at({low}, o.ball + 1)"
        others = f"filter(transform(to_pivots, (g, i) -> named_struct('gap', g, 'ball', i)), o -> {near}{'' if home else ' AND o.ball <> ball'})"
        found = F.expr(f"slice(array_sort({others}), {first}, {len(self.pivots) if most is None else most})")
        carried = [c for c in probes.columns if c not in ("ball", "ball_dist", "to_pivots")]
        return probes.select(*carried, F.explode(found).alias("o")).select(*carried, "o.ball", "o.gap")

    def meet(self, probes: DataFrame, data: DataFrame, sizes: dict[int, tuple], kernel: Callable, schema: str) -> DataFrame:
        """``kernel`` over tiles of ``probes`` (.., x, ball, gap) and of ``data`` (.., x, ball, ball_dist) of one ball."""
        asked = {r[0]: r[1] for r in probes.groupBy("ball").count().collect()}
        shares = [[-(-n // self.tile) for n in (asked.get(b, 0), sizes.get(b, (0,))[0])] for b in range(len(self.pivots))]
        pairs = sum(n * sizes.get(b, (0,))[0] for b, n in asked.items())
        wide = max(data.sparkSession.sparkContext.defaultParallelism, pairs // TASK_PAIRS)
        tasks = max(1, min(MOST_TASKS, wide, sum(p * q for p, q in shares)))
        keys = ["ball", "at_probe", "at_data"]

        def dealt(side: DataFrame, own: int) -> DataFrame:
            mine, other = (F.element_at(F.array(*[F.lit(s[i]) for s in shares]), F.col("ball") + 1) for i in (own, 1 - own))
            names = keys[1:] if own == 0 else keys[:0:-1]
            side = side.filter(F.element_at(F.array(*[F.lit(p * q) for p, q in shares]), F.col("ball") + 1) > 0)
            # Both sides may read one table, so their columns get identities of their own.
            side = side.toDF(*[f"{own}_{c}" for c in side.columns]).select(*[F.col(f"{own}_{c}").alias(c) for c in side.columns])
            return side.select(
                "*", F.pmod(F.xxhash64("x"), mine).cast("int").alias(names[0]), F.explode(F.sequence(F.lit(0), other - 1)).alias(names[1])
            ).repartition(tasks, *keys)

        if not sum(p * q for p, q in shares):
            return data.sparkSession.createDataFrame([], schema)
        return dealt(probes, 0).groupBy(*keys).cogroup(dealt(data, 1).groupBy(*keys)).applyInArrow(kernel, schema)


def _count(d: int, radius: float, reach: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        around, looked = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        if left.num_rows and right.num_rows:
            x, y = _vectors(left.column("x"), d), _vectors(right.column("x"), d)
            need, mult = left.column("need").to_numpy(), right.column("mult").to_numpy()
            for some, rows in _blocks(left, right, reach):
                some = some[around[some] < need[some]]
                if len(some):
                    around[some] += within(x[some], y[rows], radius) @ mult[rows]
                    looked[some] += len(rows)
        return pa.table({"uid": left.column("uid"), "around": around, "looked": looked})

    return run


def count_around(
    sites: DataFrame, probes: DataFrame, features: list[str], eps: float, need: Column, rows: int, report: dict | None = None
) -> DataFrame:
    """``(uid, around)`` of every probe: how many points are within ``eps``, itself and its copies included.

    ``sites`` (uid, mult, features) is staged and ``probes`` (uid) are some of them. The count is whole unless it reaches
    ``need``, an expression over ``mult``. ``report`` receives the number of pairs whose distance was taken, ``pairs``, and
    of rows, ``sites``.
    """
    if report is not None:
        report |= {"pairs": 0, "sites": rows}
    if not rows:
        return sites.sparkSession.createDataFrame([], "uid bigint, around bigint")
    balls = Balls(sites, features, eps, rows)
    placed = balls.place(sites, ["uid", "mult"])
    sizes = balls.sizes(placed)
    data = placed.select("mult", "x", "ball", "ball_dist")
    asking = placed.join(probes.select("uid"), "uid", "left_semi").withColumn("need", need)
    kernel = _count(len(features), eps, balls.reach)
    looked = 0

    def counted(side: DataFrame) -> DataFrame:
        nonlocal looked
        met = balls.meet(side, data, sizes, kernel, "uid bigint, around bigint, looked bigint")
        found, told = stage_told(
            met.groupBy("uid").agg(F.sum("around").alias("around"), F.sum("looked").alias("looked")), "around", looked=F.sum("looked")
        )
        looked += told["looked"] or 0
        return found.select("uid", "around")

    total = counted(asking.select("uid", "need", "x", "ball", F.col("ball_dist").alias("gap")))
    for first, most in ((1, NEAREST), (NEAREST + 1, None)):
        unsure = asking.join(total, "uid").filter("around < need").withColumn("need", F.col("need") - F.col("around"))
        more = counted(balls.reached(unsure.select("uid", "need", "x", "ball", "ball_dist", "to_pivots"), sizes, first, most))
        total = total.join(more.withColumnRenamed("around", "more"), "uid", "left").select(
            "uid", (F.col("around") + F.coalesce("more", F.lit(0))).alias("around")
        )
    if report is not None:
        report["pairs"] = looked
    return total


def _connect(d: int, radius: float, reach: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Pairs of cells with points within the radius, enough of them to connect what the tile connects."""
        src, dst = [], []
        if left.num_rows and right.num_rows:
            x, y = _vectors(left.column("x"), d), _vectors(right.column("x"), d)
            gid, q_gid = left.column("gid").to_numpy(), right.column("gid").to_numpy()
            names, flat = np.unique(np.concatenate([left.column("component").to_numpy(), right.column("component").to_numpy()]), return_inverse=True)
            root = np.arange(len(names))
            a, b = flat[: len(x)], flat[len(x):]
            for some, rows in _blocks(left, right, reach):
                p, q = root[a[some]], root[b[rows]]
                main = np.bincount(np.concatenate([p, q])).argmax()
                for mine, other in ((p != main, np.ones(len(q), bool)), (p == main, q != main)):
                    u, v = some[mine], rows[other]
                    if not len(u) or not len(v):
                        continue
                    i, j = np.nonzero(within(x[u], y[v], radius) & (root[a[u]][:, None] != root[b[v]]))
                    u, v = u[i], v[j]
                    _, one = np.unique(root[a[u]] * len(names) + root[b[v]], return_index=True)
                    for m, n in zip(u[one].tolist(), v[one].tolist()):
                        s, t = a[m], b[n]
                        while root[s] != s:
                            s = root[s]
                        while root[t] != t:
                            t = root[t]
                        if s != t:
                            root[max(s, t)] = min(s, t)
                            src.append(gid[m])
                            dst.append(q_gid[n])
                    while not np.array_equal(root, up := root[root]):
                        root = up
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def connecting_links(pts: DataFrame, features: list[str], radius: float) -> DataFrame:
    """Pairs ``(src, dst)`` of cells with points within ``radius``, not all, but enough to connect the same cells.

    ``pts`` is a staged table of distinct points with ``uid`` and their cell ``gid``.
    """
    rows = pts.count()
    if not rows:
        return pts.sparkSession.createDataFrame([], "src bigint, dst bigint")
    balls = Balls(pts, features, radius, rows)
    placed = balls.place(pts, ["uid", "gid"])
    sizes = balls.sizes(placed)
    kernel = _connect(len(features), radius, balls.reach)

    def linked(probes: DataFrame, data: DataFrame) -> DataFrame:
        return stage(balls.meet(probes, data.select("gid", "component", "x", "ball", "ball_dist"), sizes, kernel, "src bigint, dst bigint"), "links")

    def labeled(known: DataFrame) -> DataFrame:
        return stage(hot_join(placed, known.withColumnRenamed("id", "gid"), ["gid"], rows=rows), "labeled")

    def outside(df: DataFrame, *columns: str) -> DataFrame:
        return df.select("gid", "component", "x", "ball", "ball_dist", "to_pivots", *columns)

    single = placed.withColumn("component", F.col("gid"))
    links = linked(single.select("gid", "component", "x", "ball", F.col("ball_dist").alias("gap")), single)
    known = stage(connected_components(placed.select(F.col("gid").alias("id")).distinct(), links), "known")

    # A few points of every component find most of what connects balls.
    now = labeled(known)
    counts = stage(now.groupBy("component").count(), "counts")
    if counts.count() == 1:
        return links
    scouts = hot_join(now, counts, ["component"], rows=rows).filter(F.pmod(F.xxhash64("uid"), F.ceil(F.col("count") / SCOUTS)) == 0)
    more = linked(balls.reached(outside(scouts), sizes), now)
    known = extend_components(known, more)
    links = links.union(more)

    # Then only points outside the largest component can have anything left to find.
    now = labeled(stage(known, "known"))
    largest = now.groupBy("component").count().orderBy(F.desc("count"), "component").first()
    if largest["count"] == rows:
        return links
    rest = now.filter(F.col("component") != largest["component"])
    return links.union(linked(balls.reached(outside(rest), sizes), now))


def _lowest(d: int, radius: float, reach: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Per probe the smallest cluster within the radius, if any."""
        best, found = np.full(left.num_rows, np.iinfo(np.int64).max), np.zeros(left.num_rows, bool)
        if left.num_rows and right.num_rows:
            x, y = _vectors(left.column("x"), d), _vectors(right.column("x"), d)
            cluster = right.column("cluster_id").to_numpy()
            for some, rows in _blocks(left, right, reach):
                i, j = np.nonzero(within(x[some], y[rows], radius))
                np.minimum.at(best, some[i], cluster[rows[j]])
                found[some[i]] = True
        return pa.table({"uid": left.column("uid"), "cluster_id": best}).filter(pa.array(found))

    return run


def lowest_cluster(probes: DataFrame, owners: DataFrame, features: list[str], radius: float) -> DataFrame:
    """``(uid, cluster_id)``: of every probe the smallest cluster among the ``owners`` within ``radius``, if any.

    ``owners`` (uid, cluster_id, features) is a staged table.
    """
    schema = "uid bigint, cluster_id bigint"
    rows = owners.count()
    if not rows:
        return owners.sparkSession.createDataFrame([], schema)
    balls = Balls(owners, features, radius, rows)
    data = balls.place(owners, ["cluster_id"]).drop("to_pivots")
    sizes = balls.sizes(data)
    asking = balls.place(probes, ["uid"])
    met = balls.meet(balls.reached(asking, sizes, home=True), data, sizes, _lowest(len(features), radius, balls.reach), schema)
    return met.groupBy("uid").agg(F.min("cluster_id").alias("cluster_id"))
