"""Column expressions for distances, boxes and the seeded tolerance rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relative slack that keeps rounding from moving a pair across a search-cell boundary; it covers
# coordinates up to about 1e9 times the radius.
SLACK = 1e-6

# Fixed values of the seeded tolerance rule.
COIN_SRC = 7919
COIN_DST = 104729
COIN_MOD = 1000003


def prefixed(prefix: str, names: list[str]) -> list[str]:
    return [prefix + n for n in names]


def number(x: float) -> str:
    """SQL text of a double."""
    return f"{float(x)!r}D"


def distance(a: list[str], b: list[str]) -> Column:
    """Euclidean distance of two lists of columns, squares summed in dimension order."""
    return F.expr("sqrt(" + " + ".join(f"({p} - {q}) * ({p} - {q})" for p, q in zip(a, b)) + ")")


def box_distance(alo: list[str], ahi: list[str], blo: list[str], bhi: list[str]) -> Column:
    """Smallest possible distance between two boxes; never above the computed distance of their points."""
    gaps = [f"greatest(0D, {bl} - {ah}, {al} - {bh})" for al, ah, bl, bh in zip(alo, ahi, blo, bhi)]
    return F.expr("sqrt(" + " + ".join(f"{g} * {g}" for g in gaps) + ")")


def cell_index(x: str, width: float) -> str:
    """SQL text of the index of the cell that holds ``x``."""
    return f"floor(({x}) / {number(width)})"


def touched_cells(low: str, high: str, width: float) -> Column:
    """One row per cell between two coordinates."""
    return F.expr(f"explode(sequence({cell_index(low, width)}, {cell_index(high, width)}))")


def coin(src: Column, dst: Column, seed: int) -> Column:
    """Repeatable yes/no decision for a pair inside the tolerance band; ids are reduced first, so any id fits."""
    small_src, small_dst = F.pmod(src, F.lit(COIN_MOD)), F.pmod(dst, F.lit(COIN_MOD))
    mixed = small_src * F.lit(COIN_SRC) + small_dst * F.lit(COIN_DST) + F.lit(seed)
    return F.pmod(F.pmod(mixed, F.lit(COIN_MOD)), F.lit(2)) == 1


def z_order(columns: list[str], low: list[float], side: float, bits: int = 12) -> Column:
    """Position along a curve that keeps neighbours together: the bits of up to four whole coordinates in turn."""
    use = columns[:4]
    whole = [f"cast(least({(1 << bits) - 1}D, greatest(0D, ({c} - {number(a)}) / {number(side)} * {number(1 << bits)})) as bigint)" for c, a in zip(use, low)]
    return F.expr(" + ".join(
        f"shiftleft(shiftright({w}, {b}) & 1L, {b * len(use) + k})" for k, w in enumerate(whole) for b in range(bits)
    ))
