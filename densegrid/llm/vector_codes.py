"""Vectors compressed to one byte-sized code per part, by Lloyd rounds over cover trees.

A vector is cut into equal parts; each part position has a codebook of its own. In every chunk of rows a task builds a
cover tree over the parts of each position: a node stands for all its rows by a center (one of them), the largest
distance to it, their number and their sum; the radius halves from level to level and centers of one level are farther
apart than it. Trees are built once and written; the rounds only read them.

To assign, a node is compared with the entries by its center. With the nearest entry at distance ``m``, an entry beyond
``m`` plus twice the radius is not the nearest one of any row below (triangle inequality). If one entry is left, the
whole subtree goes there, with its sum; otherwise the children go on with the entries left, and rows of leaves are
compared with them in exact whole numbers. Distances of centers are doubles, loosened far above their rounding error.

Vectors that are null, hold null or non-finite components, or have another number of components than ``d`` are left out.
Numbers of any size are exact (rows beyond the int64 range are compared by themselves, in Python integers); an error
that does not fit a bigint is null, and so are sums it enters. Repeated rows are rows of their own; null ids come
after all others. With fewer than ``k`` rows the codebooks are shorter; without any the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegrid.llm.whole import SUMS, Sums, Whole, collect_means, finite, least_by_row, longs, squares
from densegrid.runtime import hot_join, stage

#: Rows of a chunk, and rows of a node that is not split.
CHUNK, LEAF = 4096, 8
#: Share by which distances of centers are loosened.
SLACK = 1e-9
#: Labels up to which their sums are broadcast.
FEW = 200_000


class Forest:
    """Cover trees over the rows of ``points``, one per group; rows of a group stand together.

    Nodes are numbered level by level; the rows of node ``x`` are ``order[begin[x]:end[x]]`` and its children the nodes
    ``child[x]`` to ``child[x] + children[x]``.
    """

    FIELDS = ("order", "begin", "end", "center", "radius", "child", "children", "level")

    def __init__(self, **fields: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, fields[name])

    @classmethod
    def build(cls, points: np.ndarray, sizes: np.ndarray) -> "Forest":
        order = np.arange(len(points))
        ends = np.cumsum(sizes)
        begin, end = (ends - sizes)[sizes > 0], ends[sizes > 0]
        center = begin.copy()
        nodes: dict[str, list[np.ndarray]] = {name: [] for name in cls.FIELDS[1:]}
        numbered, level = 0, 0
        scale = None
        while len(begin):
            node = np.repeat(np.arange(len(begin)), end - begin)
            rows = order[np.concatenate([np.arange(b, e) for b, e in zip(begin, end)])]
            far = _length(points[rows] - points[center[node]])
            radius = np.maximum.reduceat(far, np.r_[0, np.cumsum(end - begin)[:-1]])
            grow = (end - begin > LEAF) & (radius > 0)
            # The radius of a level is that of its tree at the top, halved; a node below it anyway goes by its own.
            scale = radius if scale is None else np.minimum(scale, radius)
            parts, first = np.where(grow, 1, 0), []
            inside = grow[node]
            member, of = rows[inside], node[inside]
            place = np.flatnonzero(inside)
            own, gap = np.zeros(len(member), np.int64), far[inside]
            picked = [(np.flatnonzero(grow), np.zeros(grow.sum(), np.int64), center[grow])]
            # Farthest member first, in all nodes at once, until every member is near a center.
            open_ = gap > scale[of] / 2
            while open_.any():
                idx = np.flatnonzero(open_)
                by = np.lexsort((-gap[idx], of[idx]))
                lead = idx[by[np.r_[True, np.diff(of[idx][by]) > 0]]]
                at, new = of[lead], member[lead]
                spot = np.full(len(begin), -1)
                spot[at] = new
                touched = np.flatnonzero(spot[of] >= 0)
                reach = _length(points[member[touched]] - points[spot[of[touched]]])
                closer = reach < gap[touched]
                own[touched[closer]] = parts[of[touched[closer]]]
                gap[touched[closer]] = reach[closer]
                picked.append((at, parts[at].copy(), new))
                parts[at] += 1
                open_ = gap > scale[of] / 2
            if len(member):
                by = np.lexsort((own, of))
                slots = np.concatenate([np.arange(b, e) for b, e in zip(begin[grow], end[grow])])
                order[slots] = member[by]
            at, number, new = (np.concatenate(x) for x in zip(*picked))
            by = np.lexsort((number, at))
            at, number, new = at[by], number[by], new[by]
            counts = np.bincount(of * (parts.max(initial=0) + 1) + own, minlength=len(begin) * (parts.max(initial=0) + 1)) if len(member) else np.zeros(0, np.int64)
            size = counts[at * (parts.max(initial=0) + 1) + number] if len(member) else np.zeros(0, np.int64)
            numbered += len(begin)
            nodes["begin"].append(begin)
            nodes["end"].append(end)
            nodes["center"].append(center)
            nodes["radius"].append(radius)
            nodes["child"].append(numbered + np.cumsum(parts) - parts)
            nodes["children"].append(parts)
            nodes["level"].append(np.full(len(begin), level))
            start = np.cumsum(size) - size
            if len(at):
                first_of = np.r_[True, at[1:] != at[:-1]]
                base = np.repeat(start[first_of], np.diff(np.r_[np.flatnonzero(first_of), len(at)]))
                new_begin = begin[at] + start - base
            else:
                new_begin = np.zeros(0, np.int64)
            scale = scale[at] / 2
            begin, end, center = new_begin, new_begin + size, new
            level += 1
        return cls(order=order, **{k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in nodes.items()})


def _length(gaps: np.ndarray) -> np.ndarray:
    return np.sqrt((gaps.astype(float) ** 2).sum(axis=1))


def assign(points: Whole, sums: np.ndarray, forest: Forest, group: np.ndarray, books: Whole, per_book: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of every row by its group's codebook.

    ``sums`` are running sums of the rows in forest order, with a row of zeros first. Returns the entry per row, the
    nodes taken as a whole (entry, number, sum per node), and the exact comparisons made.
    """
    entry = np.full(len(points), -1)
    taken: list[tuple] = []
    compared = 0
    node = np.flatnonzero(forest.level == 0)
    keep = np.ones((len(node), per_book), bool)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    near = books.near.reshape(-1, per_book, books.near.shape[1])
    while len(node):
        center = points.near[forest.center[node]]
        with np.errstate(over="ignore", invalid="ignore"):
            gap = np.sqrt(((center[:, None, :] - near[group[forest.center[node]]]) ** 2).sum(axis=2))
            gap[~keep] = np.inf
            reach = (gap.min(axis=1) + 2 * forest.radius[node]) * (1 + SLACK) + SLACK
            keep &= ~(gap > reach[:, None])
        one = keep.sum(axis=1) == 1
        whole = node[one]
        if len(whole):
            best = group[forest.center[whole]] * per_book + keep[one].argmax(axis=1)
            size = forest.end[whole] - forest.begin[whole]
            slots = np.repeat(forest.begin[whole] - np.cumsum(size) + size, size) + np.arange(size.sum())
            entry[forest.order[slots]] = np.repeat(best, size)
            taken.append((best, size, sums[forest.end[whole]] - sums[forest.begin[whole]]))
        leaf = ~one & (forest.children[node] == 0)
        if leaf.any():
            size = forest.end[node[leaf]] - forest.begin[node[leaf]]
            slots = np.repeat(forest.begin[node[leaf]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            rows = forest.order[slots]
            which, column = np.nonzero(keep[leaf][np.repeat(np.arange(leaf.sum()), size)])
            pairs.append((rows[which], column))
        down = ~one & (forest.children[node] > 0)
        count = forest.children[node[down]]
        keep = keep[down][np.repeat(np.arange(down.sum()), count)]
        node = np.repeat(forest.child[node[down]] - np.cumsum(count) + count, count) + np.arange(count.sum())
    if pairs:
        rows, column = (np.concatenate(x) for x in zip(*pairs))
        by = np.argsort(rows, kind="stable")
        rows, column = rows[by], column[by]
        compared = len(rows)
        distinct, i = np.unique(rows, return_inverse=True)
        column = group[rows] * per_book + column
        found, _ = least_by_row(i, column, squares(points, rows, books, column), len(distinct))
        entry[distinct] = found
        taken.append((found, np.ones(len(found), np.int64), points.small[distinct]))
    best, size, total = (np.concatenate(x) for x in zip(*taken)) if taken else (np.zeros(0, np.int64), np.zeros(0, np.int64), points.small[:0])
    return entry, best, size, total, compared


TREES = (
    "vec_id array<bigint>, label array<bigint>, x array<double>, begin array<int>, end array<int>, center array<int>, "
    "radius array<double>, child array<int>, children array<int>, level array<int>, `order` array<int>"
)


def _parts(x: np.ndarray, parts: int, scale: int) -> tuple[Whole, np.ndarray]:
    """All parts of the vectors, position by position, and the position of each."""
    cut = np.concatenate(np.split(x, parts, axis=1))
    return Whole(cut, scale), np.repeat(np.arange(parts), len(x))


def _plant(d: int, parts: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                held.append(batch.slice(at, CHUNK))
                n += held[-1].num_rows
                if n >= CHUNK:
                    yield chunk(held)
                    held, n = [], 0
        if n:
            yield chunk(held)

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
        points, group = _parts(x, parts, scale)
        # Rows of large numbers stay out of the trees.
        rows = np.flatnonzero(~points.is_large)
        forest = Forest.build(points.near[rows], np.bincount(group[rows], minlength=parts))
        ids, labels = (pa.array([table.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("vec_id", "label"))
        fields = [pa.array([forest.__dict__[f].astype(np.int32)], pa.list_(pa.int32())) for f in ("begin", "end", "center")]
        radius = pa.array([forest.radius.astype(float)], pa.list_(pa.float64()))
        more = [pa.array([forest.__dict__[f].astype(np.int32)], pa.list_(pa.int32())) for f in ("child", "children", "level", "order")]
        return pa.RecordBatch.from_arrays(
            [ids, labels, pa.array([x.ravel()], pa.list_(pa.float64())), *fields, radius, *more],
            names=["vec_id", "label", "x", "begin", "end", "center", "radius", "child", "children", "level", "order"],
        )

    return run


CODED = "vec_id bigint, label bigint, code string, error bigint"


def _read(batch: pa.RecordBatch, i: int, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    return {n: batch.column(batch.schema.get_field_index(n))[i].values.to_numpy(zero_copy_only=False) for n in names}


def _round(books: list[list[int]], per_book: int, d: int, parts: int, scale: int, sums_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.empty((len(books), d // parts), object)
        for e, row in enumerate(books):
            table[e] = row
        entries, total = Whole(table), Sums(len(books), d // parts)
        for batch in batches:
            for i in range(batch.num_rows):
                found = _read(batch, i, ("x", *Forest.FIELDS))
                x = found.pop("x").reshape(-1, d)
                points, group = _parts(x, parts, scale)
                rows = np.flatnonzero(~points.is_large)
                kept = Whole(points.small[rows].astype(float))
                forest = Forest(**found)
                sums = np.concatenate([np.zeros((1, d // parts), np.int64), np.cumsum(kept.small[forest.order], axis=0)])
                entry = np.empty(len(points), np.int64)
                entry[rows], best, size, added, _ = assign(kept, sums, forest, group[rows], entries, per_book)
                for r in points.large:
                    # A row of large numbers is compared with its whole codebook.
                    column = group[r] * per_book + np.arange(per_book)
                    entry[r] = least_by_row(np.zeros(per_book, np.int64), column, squares(points, np.full(per_book, r), entries, column), 1)[0][0]
                if sums_only:
                    total.add_sums(best, size, added)
                    odd = np.array(sorted(points.large), np.int64)
                    if len(odd):
                        total.add(Whole(np.array([points.large[r] for r in odd.tolist()], object)), entry[odd])
                    continue
                error = squares(points, np.arange(len(points)), entries, entry).reshape(parts, -1).sum(axis=0)
                code = (entry.reshape(parts, -1) - np.arange(parts)[:, None] * per_book).astype(np.uint8).T.copy()
                columns = [batch.column(batch.schema.get_field_index(c))[i].values for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([r.tobytes().hex() for r in code]), longs(error)], names=["vec_id", "label", "code", "error"]
                )
        if sums_only:
            yield from total.batches()

    return run


def encode(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", d: int = 64, parts: int = 16,
    k: int = 64, rounds: int = 2, scale: int = 256,
) -> DataFrame:
    """Per vector: vec_id, code (two hex digits per part), error, label_error, codebooks_sha256.

    Codebooks start as the parts of the ``k`` (at most 256) vectors with the smallest ids; each of ``rounds`` rounds
    assigns every part to the nearest entry (of equals the lower one) and moves every entry that is used to the floor of
    the mean of its parts.
    """
    if d % parts or not 0 < k <= 256:
        raise ValueError("d should be a multiple of parts, and k from 1 to 256")
    spark = vectors.sparkSession
    body = F.col(f"`{vector}`").cast("array<double>")
    kept = vectors.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{label}`").cast("bigint").alias("label"), body.alias("v")
    ).filter((F.size("v") == d) & finite(F.col("v")))
    first = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    per_book = len(first)
    start, _ = _parts(np.array([r["v"] for r in first], float), parts, scale)
    books = start.rows()
    trees = stage(kept.mapInArrow(_plant(d, parts, scale), TREES), "trees")
    for _ in range(rounds):
        books = collect_means(trees.mapInArrow(_round(books, per_book, d, parts, scale, True), SUMS), books)
    coded = stage(trees.mapInArrow(_round(books, per_book, d, parts, scale, False), CODED), "coded")

    digest = hashlib.sha256(",".join(str(x) for row in books for x in row).encode()).hexdigest()
    key = [F.col("label").isNull().alias("no_label"), F.coalesce("label", F.lit(0)).alias("of_label")]
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = F.when(F.count("error") == F.count(F.lit(1)), whole).try_cast("bigint")
    per = stage(coded.groupBy(*key).agg(fits.alias("label_error")), "labels")
    rows = coded.select("vec_id", "code", "error", *key)
    on = ["no_label", "of_label"]
    told = rows.join(F.broadcast(per), on) if per.count() <= FEW else hot_join(rows, per, on)
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
