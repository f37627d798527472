"""Vectors as whole numbers ``floor(scale * x)``: exact distances and sums of any size.

Rows whose numbers are all below a limit, nearly always all of them, are int64 arrays; others are Python integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_MAX = (1 << 63) - 1
#: Sums travel in digits of so many bits, so that adding them up in a bigint column never overflows.
DIGIT = 40
#: Pairs whose distances are taken together.
PAIRS = 1 << 15


def finite(column: Column) -> Column:
    """Whether an array is there and holds neither null nor NaN nor an infinite number."""
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class Whole:
    """Rows of whole numbers."""

    def __init__(self, numbers: np.ndarray, scale: int = 1):
        """``numbers`` are doubles, one row per vector, or Python integers (dtype object) with scale 1."""
        d = max(1, numbers.shape[1])
        self.limit = math.isqrt((1 << 60) // d)
        if numbers.dtype == object:
            large = np.array([[abs(x) > self.limit for x in row] for row in numbers], bool).reshape(numbers.shape).any(axis=1)
            exact = {int(i): list(numbers[i]) for i in np.flatnonzero(large)}
            floored = np.array([[float(max(-(10**150), min(10**150, x))) for x in row] for row in numbers]).reshape(numbers.shape)
        else:
            with np.errstate(over="ignore"):
                floored = np.clip(np.floor(numbers * float(scale)), -1e150, 1e150)
            large = (np.abs(floored) > self.limit).any(axis=1)
            exact = {int(i): [math.floor(Fraction(x) * scale) for x in numbers[i].tolist()] for i in np.flatnonzero(large)}
        #: Numbers beyond the limit, and doubles near all numbers.
        self.large, self.near = exact, floored
        self.small = np.where(large[:, None], 0.0, floored).astype(np.int64)
        self.is_large = large

    def __len__(self) -> int:
        return len(self.small)

    def row(self, i: int) -> list[int]:
        return self.large[i] if i in self.large else self.small[i].tolist()

    def rows(self) -> list[list[int]]:
        return [self.row(i) for i in range(len(self))]


def squares(a: Whole, i: np.ndarray, b: Whole, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs ``(a[i], b[j])``: int64, or Python integers if a large row takes part."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        gap = a.small[i[at: at + PAIRS]] - b.small[j[at: at + PAIRS]]
        out[at: at + PAIRS] = np.einsum("ij,ij->i", gap, gap)
    odd = np.flatnonzero(a.is_large[i] | b.is_large[j])
    if len(odd):
        out = out.astype(object)
        for p in odd.tolist():
            out[p] = sum((x - y) ** 2 for x, y in zip(a.row(int(i[p])), b.row(int(j[p]))))
    return out


def least_by_row(i: np.ndarray, j: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row 0..n-1 of the pairs, sorted by ``i``, the ``j`` of the smallest value (of equals the smallest j)."""
    if value.dtype == object:
        best: dict[int, tuple] = {}
        for r, c, v in zip(i.tolist(), j.tolist(), value.tolist()):
            best[r] = min(best.get(r, (v, c)), (v, c))
        picked = [best[r] for r in range(n)]
        least = np.empty(n, object)
        least[:] = [v for v, _ in picked]
        return np.array([c for _, c in picked], np.int64), least
    starts = np.searchsorted(i, np.arange(n))
    least = np.minimum.reduceat(value, starts) if n else value[:0]
    j_of_least = np.where(value == least[i], j, np.iinfo(np.int64).max)
    return (np.minimum.reduceat(j_of_least, starts) if n else j[:0]).astype(np.int64), least


def longs(values: np.ndarray) -> pa.Array:
    """As bigint; null where a number does not fit."""
    if values.dtype == object:
        return pa.array([int(v) if abs(v) <= LONG_MAX else None for v in values], pa.int64())
    return pa.array(values, pa.int64())


SUMS = "cell bigint, digit int, n bigint, sums array<bigint>"


class Sums:
    """Adds up rows by cell; ``batches`` gives them in digits."""

    def __init__(self, cells: int, d: int):
        self.n, self.small, self.large = np.zeros(cells, np.int64), np.zeros((cells, d), np.int64), {}

    def add(self, vectors: Whole, cell: np.ndarray) -> None:
        self.add_sums(cell, np.ones(len(cell), np.int64), vectors.small)
        for i, row in vectors.large.items():
            held = self.large.setdefault(int(cell[i]), [0] * len(row))
            self.large[int(cell[i])] = [x + y for x, y in zip(held, row)]

    def add_sums(self, cell: np.ndarray, n: np.ndarray, sums: np.ndarray) -> None:
        """Whole groups at once. A task would need more than 2**31 rows at the limit of int64 rows to overflow."""
        np.add.at(self.n, cell, n)
        np.add.at(self.small, cell, sums)

    def batches(self) -> Iterator[pa.RecordBatch]:
        cells, digits, ns, sums = [], [], [], []
        for c in np.flatnonzero(self.n).tolist():
            total = [x + y for x, y in zip(self.small[c].tolist(), self.large.get(c, [0] * self.small.shape[1]))]
            digit = 0
            while digit == 0 or any(total):
                low = [(abs(x) & ((1 << DIGIT) - 1)) * (1 if x >= 0 else -1) for x in total]
                total = [(x - y) >> DIGIT for x, y in zip(total, low)]
                cells.append(c)
                digits.append(digit)
                ns.append(int(self.n[c]) if digit == 0 else 0)
                sums.append(low)
                digit += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int64()), pa.array(digits, pa.int32()), pa.array(ns, pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
            names=["cell", "digit", "n", "sums"],
        )


def collect_means(partial: DataFrame, old: list[list[int]]) -> list[list[int]]:
    """Floors of the means per cell; ``old`` where a cell is empty. As many rows reach the driver as there are numbers in it."""
    each = partial.select("cell", "digit", "n", F.posexplode("sums").alias("place", "part"))
    rows = each.groupBy("cell", "digit", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("part")).collect()
    total: dict[int, list[int]] = {}
    count: dict[int, int] = {}
    for r in rows:
        held = total.setdefault(r["cell"], [0] * len(old[r["cell"]]))
        held[r["place"]] += r["part"] << (DIGIT * r["digit"])
        count[r["cell"]] = max(count.get(r["cell"], 0), r["n"])
    return [[x // count[c] for x in total[c]] if c in total else row for c, row in enumerate(old)]
