"""Exact deduplication: a two-pass Bloom filter separates rows that cannot repeat from rows that may.

Pass one hashes every text to two slots of a bit array of fixed size and counts the slots; a slot that was hit
twice sets its bit. Pass two looks both slots of a row up in that (broadcast, at most ``filter_bits / 8`` bytes)
array: rows with an unset bit are unique and pass straight through, only the others shuffle. A full array lets more
rows shuffle and never changes the result.

Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
the largest doc_id stays; a null doc_id is below every other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densegrid.llm.text import lower_az
from densegrid.runtime import hot_join, stage

FILTER_BITS = 1 << 27


def _slots(text: Column, filter_bits: int) -> tuple[Column, Column]:
    """Two slot numbers from 1. Full lower-casing is coarser than A-Z alone, so equal texts share their slots."""
    h = F.xxhash64(F.lower(F.coalesce(text, F.lit(""))))
    mask = F.lit(filter_bits - 1).cast("long")
    return h.bitwiseAND(mask) + 1, F.shiftrightunsigned(h, 32).bitwiseAND(mask) + 1


def repeated_bits(docs: DataFrame, text: str, filter_bits: int) -> DataFrame:
    """Pass one: ``(_block, _bits)``, the bit array in blocks of 32768 bits; blocks without a set bit are absent."""
    both = F.array(*_slots(docs[text], filter_bits))
    hits = docs.select(F.explode(both).alias("_slot")).groupBy("_slot").count().filter("count > 1")
    blocks = hits.groupBy(F.expr("bitmap_bucket_number(_slot)").alias("_block")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_slot))").alias("_bits")
    )
    return stage(blocks, "bloom")


def _probe(df: DataFrame, blocks: DataFrame, slot: str) -> DataFrame:
    """Add the boolean ``<slot>_set``."""
    few = F.broadcast(blocks.withColumnRenamed("_block", f"{slot}_block").withColumnRenamed("_bits", f"{slot}_bits"))
    at = f"bitmap_bit_position({slot})"
    byte = f"cast(conv(hex(substring({slot}_bits, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)"
    isset = F.expr(f"coalesce((shiftright({byte}, cast({at} % 8 as int)) & 1) = 1, false)")
    joined = df.withColumn(f"{slot}_block", F.expr(f"bitmap_bucket_number({slot})")).join(few, f"{slot}_block", "left")
    return joined.withColumn(f"{slot}_set", isset).drop(f"{slot}_block", f"{slot}_bits")


def suspects(docs: DataFrame, text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """Pass two: ``(_row, _may_repeat)``, the whole row as a struct and whether both of its bits are set.

    Rows are wrapped, so columns of any name can come along.
    """
    blocks = repeated_bits(docs, text, filter_bits)
    first, second = _slots(docs[text], filter_bits)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), first.alias("_s1"), second.alias("_s2"))
    probed = _probe(_probe(rows, blocks, "_s1"), blocks, "_s2")
    return probed.select("_row", F.expr("_s1_set and _s2_set").alias("_may_repeat"))


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the largest doc_id among the rows of equal text and ``kept`` says whether this row carries it.
    Repeated rows (same doc_id and text) count in ``group_size`` and have the same ``kept``; ``drop_copies``
    returns one of them. An empty table gives an empty result.
    """
    digest = F.sha2(lower_az(F.col(f"_row.`{text}`")).cast("binary"), 256)
    marked = stage(
        suspects(docs.select(doc_id, text), text, filter_bits).select(
            F.col(f"_row.`{doc_id}`").alias("doc_id"), digest.alias("text_sha256"), "_may_repeat"
        ),
        "digests",
    )
    alone = marked.filter("not _may_repeat").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    may = marked.filter("_may_repeat").drop("_may_repeat")
    groups = may.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = hot_join(may, stage(groups, "groups"), ["text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; exactly one of every set of equal texts.

    Rows that may repeat are grouped by text digest with a map-side maximum, so a group of any size sends one row
    per task. Rows that also share the doc_id are told apart by a hash of the whole row.
    """
    rows = suspects(docs, text, filter_bits)
    alone = rows.filter("not _may_repeat").select("_row")
    key = F.sha2(lower_az(F.col(f"_row.`{text}`")).cast("binary"), 256)
    order = F.struct(F.col(f"_row.`{doc_id}`"), F.xxhash64(F.to_json("_row")))
    best = rows.filter("_may_repeat").groupBy(key.alias("_key")).agg(F.max_by("_row", order).alias("_row")).select("_row")
    return alone.union(best).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
