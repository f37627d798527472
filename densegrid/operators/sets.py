"""Member sets of groups: which points a cell has, which cells a partition has, which points a cluster has.

A set is several rows ``(group, block, bits)``: block ``b`` stands for the ids ``32 b`` to ``32 b + 31`` and ``bits`` has
one bit for each of them. Rows have a fixed size, and equal ids are merged before the shuffle; a group of any size is
spread over its blocks, so it never has to fit into one row or task. Null ids are in no set; null groups are one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of a block are 2**5; a block with one id costs as much as a row of that id.
BLOCK_BITS = 5
IN_BLOCK = (1 << BLOCK_BITS) - 1


def member_sets(df: DataFrame, group: list[str], member: str) -> DataFrame:
    """``(*group, block, bits)`` with the distinct ids in column ``member``, a whole number, of each group."""
    ids = F.col(member).cast("bigint")
    one = F.expr(f"shiftleft(1L, CAST(`{member}` & {IN_BLOCK} AS INT))")
    return df.filter(ids.isNotNull()).groupBy(*group, F.shiftright(ids, BLOCK_BITS).alias("block")).agg(F.bit_or(one).alias("bits"))


def set_sizes(sets: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, n_members)``."""
    return sets.groupBy(*group).agg(F.sum(F.bit_count("bits")).alias("n_members"))


def list_members(sets: DataFrame, group: list[str], member: str) -> DataFrame:
    """``(*group, member)``: a row per id."""
    places = F.array(*[F.lit(i) for i in range(IN_BLOCK + 1)])
    held = F.filter(places, lambda i: F.getbit(F.col("bits"), i) == 1)
    return sets.select(*group, "block", F.explode(held).alias("_at")).select(
        *group, (F.shiftleft("block", BLOCK_BITS) + F.col("_at")).alias(member)
    )


def combine_sets(a: DataFrame, b: DataFrame, group: list[str], how: str) -> DataFrame:
    """``union``, ``intersect`` or ``minus`` of the sets of equal groups; a group whose set is empty has no rows.

    One aggregation over both inputs, so blocks are merged before the shuffle and no key is joined.
    """
    own, other = F.col("_a"), F.col("_b")
    rules: dict[str, Column] = {
        "union": own.bitwiseOR(other), "intersect": own.bitwiseAND(other), "minus": own.bitwiseAND(F.bitwise_not(other)),
    }
    if how not in rules:
        raise ValueError(f"unknown set operation {how!r}")
    none = F.lit(0).cast("bigint")
    rows = a.select(*group, "block", F.col("bits").alias("_a"), none.alias("_b")).union(
        b.select(*group, "block", none.alias("_a"), F.col("bits").alias("_b"))
    )
    merged = rows.groupBy(*group, "block").agg(F.bit_or("_a").alias("_a"), F.bit_or("_b").alias("_b"))
    return merged.select(*group, "block", rules[how].alias("bits")).filter("bits <> 0")
