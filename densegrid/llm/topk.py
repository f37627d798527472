"""Exact top-k inner products by a three-phase uniform threshold.

A vector's dimensions are dealt into lists; an item's score is the sum of its list scores. Phase one gathers the k
best entries of every list per query and takes the k-th best whole score among them: a safe lower limit. Divided by
the number of lists it is the uniform cutoff, which is broadcast. An item whose list scores all stay below the
cutoff cannot reach the limit, so phase two collects entries at or above it in some list and drops those whose known
list scores plus the cutoff for every other list stay below the limit. Phase three adds up the rest exactly.

Queries are met in blocks whose numbers are bounded (``NUMBERS``), which bounds what is broadcast; each block is
compared with all vectors in place, in tiles of at most 1024 queries, without moving the vectors.

List scores are products in double precision. Where components are too large for them to be exact, phase two allows
for the largest rounding error; whole scores are always sums of whole numbers (64 bits, or any length where those do
not do), so no size of a finite component changes the result. ``quantize`` counts components beyond 2^59 as 2^59. A
score is reported as the nearest 64-bit number; the order is that of the true scores.

Vectors that are null, empty or hold null or non-finite components take no part. Shorter vectors count as padded by
zeros. Rows that repeat an id are all candidates, and all of them are excluded for a query of that id; a query id
given more than once counts once, with its smallest vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densegrid.runtime import number_rows, stage

#: Largest size of a component, as a power of two: products of 64 of them fit 38 digits.
LARGEST = 59
#: Numbers in a block of queries, at most.
NUMBERS = 1 << 20
TILE = 1024


def quantize(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``(vec_id, v)`` with v = floor(scale * x) as whole numbers; rows with an unusable vector are left out."""
    x = F.col(f"`{vector}`")
    usable = F.size(x) > 0
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    far = float(1 << LARGEST)
    return vectors.filter(x.isNotNull() & usable & finite & F.col(f"`{vec_id}`").isNotNull()).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.transform(x, lambda e: F.floor(F.greatest(F.least(e.cast("double") * scale, F.lit(far)), F.lit(-far))).cast("long")).alias("v"),
    )


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Whole numbers, rows padded to ``dims``."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(ends), dims), np.int64)
    out[np.arange(dims) < ends[:, None]] = values
    return out


class _Form:
    """How scores of ``dims`` components of at most ``most`` are held: doubles, 64-bit numbers, or numbers of any length."""

    def __init__(self, dims: int, most: int):
        whole = dims * most * most
        self.dims, self.exact, self.wide = dims, whole < 1 << 53, whole >= 1 << 62
        self.kind = np.dtype(object) if self.wide else np.dtype(np.int64)
        self.type = pa.decimal128(38, 0) if self.wide else pa.int64()
        self.entry = f"query_id bigint, vec_id bigint, score {'decimal(38,0)' if self.wide else 'bigint'}"
        #: No product of a part of the components is further from the true one than this times the lengths of both.
        self.error = 0.0 if self.exact else (dims + 8) * 2.0**-51

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whole scores of equally many queries and rows."""
        if self.wide:
            return (q.astype(object) * x.astype(object)).sum(1) if len(q) else np.zeros(0, object)
        return np.einsum("ij,ij->i", q, x)

    def table(self, q: np.ndarray, v: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        values = [Decimal(int(s)) for s in score] if self.wide else score
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(values, self.type)], names=["query_id", "vec_id", "score"])


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of its k largest values, in no order; all if there are fewer."""
    return np.argpartition(scores, -k, axis=1)[:, -k:] if scores.shape[1] > k else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


def _batches(batches: Iterator[pa.RecordBatch], dims: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_numpy(), _matrix(part.column(1), dims)


class _Kept:
    """Entries of a task: those that are among the k first of their query, cut down whenever many have come in."""

    def __init__(self, form: _Form, k: int, queries: int):
        self.k, self.most, self.size = k, 8 * k * queries + 4096, 0
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, form.kind))]

    def add(self, row: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((row, vec, score))
        self.size += len(row)
        if self.size > self.most:
            self.parts = [self.rows()]
            self.size = len(self.parts[0][0])

    def rows(self):
        """The k first of every query by score and id, which is all that the whole can use of one task."""
        row, vec, score = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((vec, _ranks(score), row))
        row, vec, score = row[order], vec[order], score[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        return row[place < self.k], vec[place < self.k], score[place < self.k]


def _ranks(score: np.ndarray) -> np.ndarray:
    """Numbers that sort as the falling scores."""
    if score.dtype != object:
        return -score
    return -np.unique(score, return_inverse=True)[1] if len(score) else np.zeros(0, int)


def _ranked(entries: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return entries.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _gather(query, lists: list[np.ndarray], form: _Form, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase one: per list and query the k best entries of this task by list score; only these are added up."""
        ids, whole = query.value
        q = whole.astype(np.float64)
        kept = _Kept(form, k, len(ids))
        least = np.full((len(lists), len(ids)), -np.inf)
        for vec, rows in _batches(batches, form.dims, 4096):
            x = rows.astype(np.float64)
            for at in range(0, len(ids), TILE):
                tile = slice(at, at + TILE)
                own = ids[tile, None] == vec[None, :]
                picked = np.zeros(own.shape, bool)
                for n, d in enumerate(lists):
                    part = q[tile, d] @ x[:, d].T
                    part[own] = -np.inf
                    best = _best(part, k)
                    value = np.take_along_axis(part, best, 1)
                    new = value > least[n, tile, None]
                    row, col = np.nonzero(new)
                    picked[row, best[row, col]] = True
                    if best.shape[1] == k:
                        least[n, tile] = np.maximum(least[n, tile], value.min(1))
                row, col = np.nonzero(picked & ~own)
                kept.add(row + at, vec[col], form.scores(whole[row + at], rows[col]))
        row, vec, score = kept.rows()
        yield form.table(ids[row], vec, score)

    return run


def _resolve(query, limits, lists: list[np.ndarray], form: _Form, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases two and three: entries at or above the cutoff, bounded from above, the rest added up exactly."""
        ids, whole = query.value
        q, limit = whole.astype(np.float64), limits.value
        cut, far = limit / len(lists), _length(whole)
        kept = _Kept(form, k, len(ids))
        for vec, rows in _batches(batches, form.dims, 2048):
            x, long = rows.astype(np.float64), _length(rows)
            for at in range(0, len(ids), TILE):
                tile = slice(at, at + TILE)
                upper = np.zeros((len(ids[tile]), len(vec)))
                seen = np.zeros(upper.shape, bool)
                slack = form.error * far[tile, None] * long if form.error else 0.0
                for d in lists:
                    part = q[tile, d] @ x[:, d].T + slack
                    seen |= part >= cut[tile, None]
                    upper += np.maximum(part, cut[tile, None])
                if form.error:
                    upper += slack
                row, col = np.nonzero(seen & (upper >= limit[tile, None]) & (ids[tile, None] != vec[None, :]))
                kept.add(row + at, vec[col], form.scores(whole[row + at], rows[col]))
        row, vec, score = kept.rows()
        yield form.table(ids[row], vec, score)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = 8, block: int = 16384) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best other rows, ties to the smaller vec_id.

    Both inputs are ``(vec_id, v)`` of whole numbers, as ``quantize`` gives. Fewer than k candidates: all of them.
    """
    spark = vectors.sparkSession
    vectors = stage(vectors, "vectors")
    bound = vectors.agg(F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()
    dims = bound["d"] or 0
    form = _Form(dims, bound["m"] or 0)
    dealt = [d for d in np.array_split(np.arange(dims), lists) if len(d)]
    block = max(1, min(block, NUMBERS // max(dims, 1)))
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    numbered = stage(number_rows(queries, ["vec_id"], "_at").withColumn("_block", F.expr(f"_at div {block}")), "queries")
    blocks = numbered.agg(F.max("_block")).first()[0]
    found = []
    for b in range(0 if blocks is None else blocks + 1):
        rows = numbered.filter(F.col("_block") == b).orderBy("_at").select("vec_id", "v").collect()
        q = np.zeros((len(rows), dims), np.int64)
        for i, r in enumerate(rows):
            q[i, : len(r["v"])] = r["v"]
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        query = spark.sparkContext.broadcast((ids, q))
        first = _ranked(vectors.mapInArrow(_gather(query, dealt, form, k), form.entry), k)
        low = {r[0]: r[1] for r in first.groupBy("query_id").agg(F.min("score"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n").collect()}
        # Above 2^53 a limit may be rounded up; the next smaller double is safe.
        limit = np.array([np.nextafter(float(low[i]), -np.inf) if i in low else -np.finfo(float).max / 16 for i in ids.tolist()])
        entries = vectors.mapInArrow(_resolve(query, spark.sparkContext.broadcast(limit), dealt, form, k), form.entry)
        found.append(_ranked(entries, k))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    score = F.col("score")
    if form.wide:
        edge = [F.lit(str(x)).cast("decimal(38,0)") for x in (-(1 << 63), (1 << 63) - 1)]
        score = F.greatest(F.least(score, edge[1]), edge[0]).cast("long")
    return out.select("query_id", "rank", "vec_id", score.alias("score"))
