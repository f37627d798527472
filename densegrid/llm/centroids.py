"""Clustering around centroids in whole numbers, with N-simplex projection as the filter.

A few pivots are fixed before the first round. The distances of a vector to them are cached once as the coordinates
of the apex that it forms over the simplex of the pivots. For two apexes the Euclidean distance of the coordinates is a
lower bound of the distance of the vectors, and the same with the last coordinate of one of them turned around an upper
bound. In every round the centroids get apexes too; a centroid whose lower bound is above the smallest upper bound of a
vector is out, and only the others are compared with it, in exact whole numbers.

Vectors without exactly ``d`` components, or with null or non-finite ones, are left out. Numbers of any size are exact
(Python integers beyond the int64 range); a result that does not fit a bigint is null, and so are sums it enters.
Repeated rows are vectors of their own. A null vec_id is a vector like others but never a starting centroid. With fewer
than ``k`` vectors there are fewer centroids; without any the result is empty. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegrid.llm.whole import SUMS, Sums, Whole, collect_means, finite, least_by_row, longs, squares
from densegrid.runtime import stage

PIVOTS = 24
#: A pivot has to stand out of the simplex of those before it by this share of the first edge.
STANDS_OUT = 0.1
#: Share of the squared scale by which bounds are loosened, far above their rounding error.
SLACK = 1e-6
#: Squared distances from which doubles are no longer relied on.
FAR = 10**200


class Simplex:
    """Pivots and the base that turns distances to them into apex coordinates."""

    def __init__(self, points: list[list[int]], most: int = PIVOTS):
        """Pick pivots among ``points``, each time the one that stands out most."""
        everything = _whole(points)
        picked, base, width = [0], np.zeros((0, 0)), 0.0
        while len(picked) < min(most, len(points)):
            self._set(_whole([points[i] for i in picked]), base)
            height = np.nan_to_num(self.apexes(everything)[:, -1], nan=-1.0)
            height[picked] = -1.0
            best = int(np.argmax(height))
            if not height[best] > max(0.0, STANDS_OUT * width):
                break
            width = width or float(height[best])
            picked.append(best)
            edges = everything.near[picked[1:]] - everything.near[picked[0]]
            base = np.linalg.cholesky(edges @ edges.T)
        self._set(_whole([points[i] for i in picked]), base)

    def _set(self, pivots: Whole, base: np.ndarray) -> None:
        self.pivots, self.base = pivots, base
        self.lengths = (base**2).sum(axis=1)

    def apexes(self, vectors: Whole) -> np.ndarray:
        """One row per vector: its coordinates along the base and, last, its height above it."""
        m, n = len(self.pivots), len(vectors)
        rows, pivots = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
        d2 = squares(vectors, rows, self.pivots, pivots)
        # Beyond that no bound is claimed.
        d2 = np.array([float(x) if x < FAR else np.nan for x in d2]) if d2.dtype == object else d2.astype(float)
        d2 = d2.reshape(n, m)
        along = (d2[:, :1] + self.lengths - d2[:, 1:]) / 2
        for k in range(m - 1):
            along[:, k] = (along[:, k] - along[:, :k] @ self.base[k, :k]) / self.base[k, k]
        height = np.sqrt(np.maximum(0.0, d2[:, 0] - (along**2).sum(axis=1)))
        return np.concatenate([along, height[:, None]], axis=1)


def _whole(points: list[list[int]]) -> Whole:
    table = np.empty((len(points), len(points[0])), object)
    for i, row in enumerate(points):
        table[i] = row
    return Whole(table)


def nearest(vectors: Whole, apexes: np.ndarray, centroids: Whole, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of every vector, and how many distances that took."""
    with np.errstate(over="ignore", invalid="ignore"):
        flat = (apexes[:, None, :-1] - tops[None, :, :-1]) ** 2
        flat = flat.sum(axis=2)
        low = flat + (apexes[:, None, -1] - tops[None, :, -1]) ** 2
        high = flat + (apexes[:, None, -1] + tops[None, :, -1]) ** 2
        scale = SLACK * ((apexes**2).sum(axis=1)[:, None] + (tops**2).sum(axis=1)[None, :])
        # What is not a number is no reason to leave a centroid out.
        out = low - scale > (high + scale).min(axis=1, keepdims=True)
    rows, columns = np.nonzero(~out)
    found, distance = least_by_row(rows, columns, squares(vectors, rows, centroids, columns), len(vectors))
    return found, distance, len(rows)


def _numbers(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


CACHED = "vec_id bigint, v array<double>, apex array<double>"
CHUNK = 4096


def _cache(simplex: Simplex, d: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                apexes = simplex.apexes(Whole(_numbers(part.column(1), d), scale))
                cuts = pa.array(np.arange(part.num_rows + 1) * apexes.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(cuts, pa.array(apexes.ravel()))], names=["vec_id", "v", "apex"]
                )

    return run


ASSIGNED = "vec_id bigint, cluster int, distance bigint"


def _assign(simplex: Simplex, centroids: list[list[int]], d: int, scale: int, sums_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(centroids)
        tops, sums = simplex.apexes(whole), Sums(len(whole), d)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                vectors = Whole(_numbers(part.column(1), d), scale)
                cluster, distance, _ = nearest(vectors, _numbers(part.column(2), tops.shape[1]), whole, tops)
                if sums_only:
                    sums.add(vectors, cluster)
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(cluster.astype(np.int32)), longs(distance)], names=["vec_id", "cluster", "distance"]
                    )
        if sums_only:
            yield from sums.batches()

    return run


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", d: int = 64, k: int = 40, rounds: int = 5,
    scale: int = 256, seed: int = 2,
) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Starting centroids are the ``k`` vectors with the smallest SHA-256 of ``<seed>:<vec_id>``. A round assigns every
    vector to its nearest centroid (of equals the one with the smallest number) and moves every centroid that has
    vectors to the floor of their mean.
    """
    spark = vectors.sparkSession
    body = F.col(f"`{vector}`").cast("array<double>")
    kept = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), body.alias("v")).filter((F.size("v") == d) & finite(F.col("v")))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.filter("vec_id is not null").select(rank.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    schema = ASSIGNED + ", cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = Whole(np.array([r["v"] for r in first], float), scale).rows()
    simplex = Simplex(centroids)
    cached = stage(kept.mapInArrow(_cache(simplex, d, scale), CACHED), "apexes")
    for _ in range(rounds):
        centroids = collect_means(cached.mapInArrow(_assign(simplex, centroids, d, scale, True), SUMS), centroids)
    assigned = stage(cached.mapInArrow(_assign(simplex, centroids, d, scale, False), ASSIGNED), "assigned")

    # At most k rows.
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = assigned.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), whole).alias("s")).collect()
    total = sum(r["s"] for r in per) if all(r["s"] is not None for r in per) else None

    def fits(x):
        return None if x is None or x >= 1 << 63 else int(x)

    told = [
        (r["cluster"], fits(r["s"]), fits(total), hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in per
    ]
    table = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
