"""Mixing sources to target weights by the cube method.

Targets. Every source gets a share of ``share`` x all sizes by weight; a target stops at ``most`` x the source's size
and the excess goes to the other sources by weight, until no target is above its limit.

Copies. A document of a source with target / size = r is taken floor(r) times for certain and once more with
probability r - floor(r). The cube method decides that last copy: starting from the probabilities it moves along
directions that leave both totals of the source, documents and sizes, unchanged until a probability hits 0 or 1.
With two totals, any three open documents span such a direction, so at most two stay open. That flight runs on
bounded chunks of a source at once; the documents that stay open meet in the next, smaller round, until every source
has one chunk. The last few open ones of a source (at most ten) are landed by the way with the smallest error in size.

All random choices are hashes of the row and the seed, so reruns agree. Null text has size 0. Documents of size 0 are
open like all others and add nothing. Null sources form one source, last in order. Repeated rows are rows of their
own. Sources of total size 0 have target 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densegrid.runtime import hot_join, number_rows, stage

#: Words for sizes, and the weights dealt to the sources in order of code points.
SIZE_WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``(group, src, last, source_size, target)`` from rows ``(src, last, size)``; one row per source.

    One small job per round over the table of sources; a round fixes at least one source at its limit.
    """
    per = sizes.groupBy("src", "last").agg(F.sum("size").alias("source_size"))
    dealt = F.element_at(F.array(*map(F.lit, weights)), (F.col("group") % len(weights) + 1).cast("int"))
    state = stage(number_rows(per, ["last", "src"], "group").withColumn("weight", dealt), "sources")
    whole = state.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    whole_size, open_weight, used, level = share * (whole["size"] or 0), whole["weight"] or 0.0, 0.0, 0.0
    limit = F.col("source_size") * most
    while open_weight:
        level = (whole_size - used) / open_weight
        full = F.col("weight") * level > limit
        now = state.agg(
            F.sum(F.when(full, limit).otherwise(0.0)).alias("used"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if now["weight"] == open_weight:
            break
        used, open_weight = now["used"], now["weight"]
    target = F.least(F.col("weight") * level, limit) if open_weight else limit
    return stage(state.select("group", "src", "last", "source_size", target.cast("double").alias("target")), "targets")


def _fly(probability: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Move probabilities, in the order given, until at most two are strictly between 0 and 1.

    Both ``sum(p)`` and ``sum(p * size)`` stay as they were. ``draw`` are uniform numbers, one per document.
    """
    p = probability.astype(float).tolist()
    size, draw = size.astype(float).tolist(), draw.tolist()
    hold: list[int] = []
    for i in range(len(p)):
        if p[i] <= 0.0 or p[i] >= 1.0:
            continue
        hold.append(i)
        while len(hold) == 3:
            a, b, c = hold
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[j]) / x if x > 0 else -p[j] / x for j, x in zip(hold, u) if x)
            down = min(p[j] / x if x > 0 else (p[j] - 1) / x for j, x in zip(hold, u) if x)
            go = up if draw[i] * (up + down) < down else -down
            for j, x in zip(hold, u):
                p[j] += go * x
                p[j] = 0.0 if p[j] < 1e-9 else 1.0 if p[j] > 1 - 1e-9 else p[j]
            hold = [j for j in hold if 0.0 < p[j] < 1.0]
    return np.array(p)


#: Documents of a source that the last flight leaves to the landing, besides the two it cannot decide.
LANDING = 8


def _land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the open ones (at most ``LANDING`` + 2) by trying all ways: least error in size, then in number."""
    at = np.flatnonzero((p > 0) & (p < 1))
    ways = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    moved = ways - p[at]
    error = np.abs(moved @ size[at]) + 0.01 * size[at].sum() / max(1, len(at)) * np.abs(moved.sum(1))
    out = p.copy()
    out[at] = ways[np.argmin(error)]
    return out


FLIGHT = "row long, tag long, group long, size long, p double"


def _round(open_rows: DataFrame, chunks: DataFrame, last: bool, seed: int) -> DataFrame:
    """One flight: rows of a chunk come together by key, sorted; chunks are bounded, so a task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "row", "tag", "group", "size", "p", "draw"]
        kept: list[dict] = []
        held = None

        def flush():
            cols = {n: np.concatenate([k[n] for k in kept]) for n in names}
            p = cols["p"].copy()
            stop = max(0, len(p) - LANDING) if last else len(p)
            p[:stop] = _fly(p[:stop], cols["size"][:stop], cols["draw"][:stop])
            p = _land(p, cols["size"]) if last else p
            out = ["row", "tag", "group", "size"]
            return pa.RecordBatch.from_arrays([*(pa.array(cols[n]) for n in out), pa.array(p)], names=[*out, "p"])

        for batch in batches:
            cols = {n: batch.column(n).to_numpy() for n in names}
            key = np.rec.fromarrays([cols["group"], cols["chunk"]])
            ends = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)] if len(key) else []
            start = 0
            for end in ends:
                now = (cols["group"][start], cols["chunk"][start])
                if held is not None and now != held:
                    yield flush()
                    kept = []
                held = now
                kept.append({n: cols[n][start:end] for n in names})
                start = end
        if kept:
            yield flush()

    # Rows are dealt by a hash of their tag, so chunks of a source differ in size by chance only.
    deal = F.pmod(F.xxhash64(F.lit(seed), "tag"), F.col("chunks"))
    draw = F.pmod(F.xxhash64(F.lit(-seed), "tag"), F.lit(1 << 30)) / float(1 << 30)
    keyed = hot_join(open_rows, chunks, ["group"])
    keyed = keyed.select(deal.alias("chunk"), "row", "tag", "group", "size", "p", draw.alias("draw"))
    placed = keyed.repartition("group", "chunk").sortWithinPartitions("group", "chunk", "draw", "tag", "row")
    return placed.mapInArrow(run, FLIGHT)


def sample_copies(rows: DataFrame, seed: int = 7, chunk: int = 20_000) -> DataFrame:
    """``(row, p)`` with p 0 or 1 for rows ``(row, tag, group, size, p)``; both totals of every group are kept."""
    out = rows.filter("p <= 0 or p >= 1").select("row", "p")
    open_rows = rows.filter("p > 0 and p < 1").select("row", "tag", "group", "size", "p")
    while True:
        count = open_rows.groupBy("group").count()
        chunks = stage(count.select("group", F.ceil(F.col("count") / chunk).alias("chunks")), "chunks")
        last = (chunks.agg(F.max("chunks")).first()[0] or 1) <= 1
        flown = stage(_round(open_rows, chunks, last, seed), "cube")
        if last:
            return out.union(flown.select("row", "p"))
        out = out.union(flown.filter("p <= 0 or p >= 1").select("row", "p"))
        open_rows = flown.filter("p > 0 and p < 1")
        seed += 1


def decide(rows: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows ``(row, tag, size, source)``; ``row`` is unique.

    ``tag`` drives the draws and should identify a document whatever the partitions, so that reruns agree.
    """
    keyed = rows.withColumn("src", F.coalesce("source", F.lit(""))).withColumn("last", F.col("source").isNull())
    targets = source_targets(keyed, share, most, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = hot_join(keyed, targets, ["src", "last"]).withColumn("rate", rate).withColumn("p", F.col("rate") - F.floor("rate"))
    rated = stage(rated.drop("src", "last"), "rated")
    picked = sample_copies(rated, seed).select("row", F.col("p").cast("long").alias("once_more"))
    return rated.join(picked, "row").withColumn("copies", F.floor("rate") + F.col("once_more")).drop("rate", "p", "once_more", "group")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SIZE_WORD)).cast("long")


def taken(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0,
          weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target (of its source), taken (size x copies)."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), word_count(F.col(f"`{text}`")).alias("size"),
        F.col(f"`{source}`").cast("string").alias("source"),
    )
    rows = stage(rows.withColumn("tag", F.xxhash64("doc_id", "source", "size")), "sizes")
    return decide(rows, share, most, weights, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: float = 2.0,
        weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, all columns."""
    whole = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")), "mixed")
    rows = whole.select("row", word_count(F.col(f"_doc.`{text}`")).alias("size"), F.col(f"_doc.`{source}`").cast("string").alias("source"), F.col(f"_doc.`{doc_id}`").alias("doc_id"))
    rows = stage(rows.withColumn("tag", F.xxhash64("doc_id", "source", "size")), "sizes")
    copies = decide(rows, share, most, weights, seed).filter("copies > 0").select("row", "copies")
    again = whole.join(copies, "row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
