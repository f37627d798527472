"""Grid over the data range: bounds, cell counts, bin edges, cell location, cell ids."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densegrid.functions.geometry import number
from densegrid.runtime import hot_join, stage

MAX_ID = 1 << 62


def bounds(points: DataFrame, features: list[str]) -> DataFrame:
    """Smallest and largest value per dimension: ``(dim, lo, hi)``, one scan."""
    row = points.agg(*[F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f) for f in features])
    dims = F.array(
        *[F.struct(F.lit(k).alias("dim"), F.col(f)["lo"].alias("lo"), F.col(f)["hi"].alias("hi"))
          for k, f in enumerate(features)]
    )
    return row.select(F.explode(dims).alias("b")).select("b.dim", "b.lo", "b.hi")


def linear(indexes: list[str], sizes) -> str:
    """SQL text of a row-major linear id."""
    out = indexes[0]
    for index, size in zip(indexes[1:], sizes[1:]):
        out = f"({out}) * {size}L + {index}"
    return out


def cell_side(eps: float, n_features: int) -> float:
    return eps / math.sqrt(n_features)


@dataclass(frozen=True)
class Grid:
    """Cell layout of a point set. ``stretched`` fits whole cells to the range, ``exact`` keeps the side."""

    features: tuple[str, ...]
    lo: tuple[float, ...]
    hi: tuple[float, ...]
    n: tuple[int, ...]
    width: tuple[float, ...]
    eps: float

    @classmethod
    def fit(cls, points: DataFrame, features: list[str], eps: float, kind: str = "stretched") -> "Grid":
        if kind not in ("stretched", "exact"):
            raise ValueError(f"unknown grid kind {kind!r}")
        row = points.agg(
            *[F.min(f).alias(f"lo{k}") for k, f in enumerate(features)],
            *[F.max(f).alias(f"hi{k}") for k, f in enumerate(features)],
        ).first()
        lo = [row[f"lo{k}"] for k in range(len(features))]
        hi = [row[f"hi{k}"] for k in range(len(features))]
        if any(v is None for v in lo):
            lo = hi = [0.0] * len(features)
        if any(math.isnan(v) or math.isinf(v) for v in lo + hi):
            raise ValueError("features must be finite; filter them with valid_points first")
        side = cell_side(eps, len(features))
        n, width = [], []
        for a, b in zip(lo, hi):
            whole = math.floor((b - a) / side)
            if kind == "stretched":
                n.append(max(1, whole))
                width.append((b - a) / n[-1])
            else:
                n.append(whole + 1)
                width.append(side)
        return cls(tuple(features), tuple(lo), tuple(hi), tuple(n), tuple(width), eps)

    @property
    def cells(self) -> list[str]:
        return [f"c{k}" for k in range(len(self.features))]

    @property
    def fits(self) -> bool:
        return math.prod(self.n) < MAX_ID

    def cell(self, k: int, x: str) -> str:
        """SQL text of the cell index in dimension ``k``: left-closed bins, clamped to the first and last."""
        if self.width[k] == 0:
            return "0L"
        raw = f"floor(({x} - {number(self.lo[k])}) / {number(self.width[k])})"
        return f"least({self.n[k] - 1}L, greatest(0L, {raw}))"

    def gid(self, cells: list[str]) -> str:
        """SQL text of the row-major linear id of a cell, last dimension fastest."""
        return linear(cells, self.n)

    def unlinear(self, gid: Column) -> list[Column]:
        """Cell position of a linear id."""
        out: list[Column] = []
        rest = gid
        for k in range(len(self.n) - 1, 0, -1):
            size = F.lit(self.n[k]).cast("bigint")
            out.append(F.pmod(rest, size).cast("bigint"))
            rest = F.call_function("div", rest, size)
        out.append(rest)
        return out[::-1]

    def locate(self, df: DataFrame) -> DataFrame:
        """Add the cell position ``c0..`` of every row."""
        found = [F.expr(self.cell(k, f)).alias(c) for k, (f, c) in enumerate(zip(self.features, self.cells))]
        return df.select("*", *found)

    def attach_gid(self, df: DataFrame, key: str) -> DataFrame:
        """Add ``gid``. When the linear id would not fit in 62 bits, a cell is named by its smallest ``key``."""
        if self.fits:
            return df.select("*", F.expr(self.gid([self.cell(k, f) for k, f in enumerate(self.features)])).alias("gid"))
        df = self.locate(df)
        df = stage(df, "located")
        names = df.groupBy(*self.cells).agg(F.min(key).alias("gid"))
        return hot_join(df, names, self.cells).drop(*self.cells)

    def table(self, spark: SparkSession) -> DataFrame:
        """The layout as rows ``(dim, lo, hi, n, width)``."""
        rows = list(zip(range(len(self.n)), self.lo, self.hi, self.n, self.width))
        return spark.createDataFrame(rows, "dim int, lo double, hi double, n long, width double")


def bin_edges(layout: DataFrame) -> DataFrame:
    """All bin edges of a layout table, n + 1 per dimension: ``(dim, i, edge)``."""
    return layout.select(
        "dim",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n"))).alias("i"),
        "lo",
        "width",
    ).select("dim", "i", (F.col("lo") + F.col("i") * F.col("width")).alias("edge"))


def cell_box(df: DataFrame, grid: Grid) -> DataFrame:
    """Add the lower and upper bound ``lo_k`` / ``hi_k`` of the cell ``c0..`` of each row."""
    for k in range(len(grid.n)):
        c = F.col(f"c{k}")
        df = df.withColumn(f"lo{k}", F.lit(grid.lo[k]) + c * F.lit(grid.width[k]))
        df = df.withColumn(f"hi{k}", F.lit(grid.lo[k]) + (c + 1) * F.lit(grid.width[k]))
    return df


def checked_points(
    points: DataFrame, features: list[str], invalid: str = "raise", scope: list[str] = []
) -> tuple[DataFrame, list[str]]:
    """``point_id`` and the features, with the contract of all public calls: features are present and finite.

    A row that breaks it stops the job (``invalid="raise"``, checked where the row is read, at no extra pass) or is
    left out (``"drop"``). Features whose names are no plain identifiers get plain ones.
    """
    if invalid not in ("raise", "drop"):
        raise ValueError(f"unknown invalid {invalid!r}")
    if len(set(features)) < len(features) or not features:
        raise ValueError("features must be distinct columns, at least one")
    plain = [f if re.fullmatch(r"[A-Za-z]\w*", f) else f"feature_{k}" for k, f in enumerate(features)]
    columns = [F.col(f"`{f}`").cast("double").alias(p) for f, p in zip(features, plain)]
    points = points.select(*scope, "point_id", *columns)
    if invalid == "drop":
        return valid_points(points, plain), plain
    fine = reduce(lambda a, b: a & b, [F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")) for p in plain])
    wrong = F.raise_error(F.concat(F.lit("features must be finite; point "), F.coalesce(F.col("point_id").cast("string"), F.lit("without id"))))
    return points.filter(F.when(fine, F.lit(True)).otherwise(wrong)), plain


def valid_points(points: DataFrame, features: list[str]) -> DataFrame:
    """Keep rows whose features are all present and finite."""
    for f in features:
        x = F.col(f)
        points = points.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return points
