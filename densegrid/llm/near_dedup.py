"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of shingles (five words; a shorter text is one shingle). Equal shingles are told apart by their
occurrence number. A sketch takes the few smallest of them under its own hash and keeps them in text order, so two
texts agree on a sketch only if they share these shingles in the same order. Texts that agree on a sketch meet in a
bucket. Short texts also meet by every sequence that is left when as many shingles go as a link may lack, so no link
between two of them is missed. Of buckets with the same members one is kept. A pair is a link when aligning the two shingle sequences inside a band gives
``common / (a + b - common)`` of at least ``similarity``; the band is as wide as the similarity allows shifts, so no
link is lost to it. Classes are the connected components of the links.

Texts with the same words are one node, so copies never pair up. In a bucket first one leader, the member that meets
most others in its buckets, is aligned with all members, which also gives the distances of those linked to it. A leader
has met its whole bucket and leaves it, and so do buckets whose other members are of one class; in a bucket of two nothing
is left. Then every member outside the largest class of those left becomes a leader (in rounds that grow) and is compared
with the members of other classes. Before a pair is made, three exact tests must allow a link: the sizes; the distances of both to the
first leader (triangle inequality); and the shingles in common, at most what the smaller counts of all ``CELLS``
classes of shingles add up to, where shingles that no other open text has do not count. Near misses of a group differ in
shingles of their own, so nearly all of them fall there: a member with a fifth of them cannot have a link at all. A pair
that shares a bucket is thus aligned, ruled out or already in one class; groups of near copies cost one alignment per
member, not per pair. New links are added to the classes known so far by contraction.

Texts without words form one class. Null text counts as empty. Repeated rows are copies. A class is named by its
smallest doc_id; null ids are above all others. Nodes go by a 64-bit hash of their words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densegrid.llm.text import words
from densegrid.operators.components import connected_components, extend_components
from densegrid.runtime import HOT_ROWS, hot_cut, hot_join, setting, stage, stage_told

SHINGLE, SIMILARITY = 5, 0.8
#: Sketches, and shingles in each. A pair at similarity 0.8 misses all buckets with a probability of about 3e-6 if the
#: texts are long and of 2e-5 at most (12 shingles in common, 3 not) if one has more than SHORT; repeats add to it.
SKETCHES, TAKEN = 24, 4
#: Two texts of at most so many shingles never miss each other.
SHORT = 11
#: Ids that are broadcast; more of them are joined by a shuffle.
FEW = 1_000_000


def shingles(ids: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the k-word windows; one for all words if there are fewer than k, none without words."""
    ids = ids.astype(np.uint64)
    k = min(k, len(ids))
    if not k:
        return ids
    out = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ ids[j: len(ids) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def sketch(grams: np.ndarray, multipliers: np.ndarray, taken: int = TAKEN) -> np.ndarray:
    """One key per multiplier: its ``taken`` smallest occurrence-labelled shingles in text order, hashed."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    occurrence = np.empty(len(grams), np.uint64)
    occurrence[order] = np.arange(len(grams)) - np.repeat(starts, np.diff(np.r_[starts, len(grams)]))
    labelled = (grams ^ (occurrence * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
    labelled ^= labelled >> np.uint64(31)
    values = labelled[None, :] * multipliers[:, None]
    values ^= values >> np.uint64(32)
    least = np.argpartition(values, taken - 1, axis=1)[:, :taken] if len(grams) > taken else np.tile(np.arange(len(grams)), (len(multipliers), 1))
    picked = labelled[np.sort(least, axis=1)]
    keys = np.arange(len(multipliers), dtype=np.uint64)
    for j in range(picked.shape[1]):
        keys = (keys ^ picked[:, j]) * np.uint64(0x94D049BB133111EB)
        keys ^= keys >> np.uint64(30)
    return keys.view(np.int64)


def short_keys(grams: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of the shingle sequence and of what is left of it without as many shingles as a link may lack."""
    at, out = np.arange(len(grams)), []
    for gone in range(int(len(grams) * (1 - similarity) + 1e-9) + 1):
        stay = np.array(list(combinations(at, len(grams) - gone)))
        keys = np.full(len(stay), gone - len(grams)).astype(np.uint64)
        for j in range(stay.shape[1]):
            keys = (keys ^ grams[stay[:, j]]) * np.uint64(0x94D049BB133111EB)
            keys ^= keys >> np.uint64(30)
        out.append(keys)
    return np.concatenate(out).view(np.int64)


def in_order(a: list, b: list, band: int | None = None) -> int:
    """Length of the longest common subsequence, of places at most ``band`` apart if given.

    Bit-parallel: a bit of ``row`` is unset where the subsequence grows at its place of b. Only the ``2 * band + 1``
    places around the one in a are held; places that fall out on the left are counted.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start: len(a) - end], b[start: len(b) - end]
    if not a or not b:
        return start + end
    band = max(len(a), len(b)) if band is None else band
    places: dict = {}
    for j, g in enumerate(b):
        places.setdefault(g, []).append(j)
    low, high = 0, min(len(b), band + 1)
    row, grown = (1 << high) - 1, 0
    for i, g in enumerate(a):
        if i - band > low:
            grown += not row & 1
            row >>= 1
            low += 1
        if i + band >= high and high < len(b):
            row |= 1 << (high - low)
            high += 1
        if low >= high:
            break
        here = places.get(g)
        if here:
            hit = 0
            for j in here[bisect_left(here, low): bisect_left(here, high)]:
                hit |= 1 << (j - low)
            both = row & hit
            if both:
                row = ((row + both) | (row & ~hit)) & ((1 << (high - low)) - 1)
    return start + end + grown + (high - low) - row.bit_count()


def ordered_similarity(a: list, b: list, least: float) -> float:
    """``common / (len(a) + len(b) - common)`` with the longest common subsequence inside the band; 0 if below ``least``."""
    whole = len(a) + len(b)
    if not whole:
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common = in_order(a, b, int(whole * (1 - least) / (1 + least) + 1e-9))
    found = common / (whole - common)
    return found if found >= least - 1e-12 else 0.0


def _joined(text: Column) -> Column:
    """The words of ``text`` with one blank between them."""
    return F.array_join(words(text), " ")


def _node(text: Column) -> Column:
    return F.xxhash64(_joined(text))


SKETCHED = "node bigint, doc_id bigint, size int, keys array<bigint>"


def _sketches(multipliers: np.ndarray, k: int, taken: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            lists = batch.column(2)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i in range(batch.num_rows):
                grams = shingles(values[ends[i]: ends[i + 1]].view(np.uint64), k)
                sizes.append(len(grams))
                keys.append(sketch(grams, multipliers, taken) if len(grams) else np.zeros(0, np.int64))
                if 0 < len(grams) <= SHORT:
                    keys[-1] = np.r_[keys[-1], short_keys(grams, similarity)]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))],
                names=["node", "doc_id", "size", "keys"],
            )

    return run


#: Classes of shingles by hash in which texts are compared before they are aligned.
CELLS = 128
GRAMS = "gram bigint, node bigint, n int"


def _grams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts -> their different shingles, with the number of each."""
        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for at in range(0, batch.num_rows, 256):
                found = []
                for i in range(at, min(at + 256, batch.num_rows)):
                    grams, n = np.unique(shingles(values[ends[i]: ends[i + 1]].view(np.uint64), k), return_counts=True)
                    found.append((grams, np.full(len(grams), batch.column(0)[i].as_py(), np.int64), n))
                grams, node, n = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(node), pa.array(n.astype(np.int32))], names=["gram", "node", "n"])

    return run


def _repeated(table: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows of ``table``, of which there are ``rows``, whose key occurs twice or more. One count finds these keys and the hot ones.

    Up to ``FEW`` keys are broadcast, and no row of ``table`` moves.
    """
    counts, told = stage_told(table.groupBy(key).count().filter("count > 1"), "shared", largest=F.max("count"))
    if told["rows"] <= FEW:
        return table.join(F.broadcast(counts.select(key)), key, "left_semi")
    cut = hot_cut(setting(table.sparkSession, HOT_ROWS), rows)
    if (told["largest"] or 0) < cut:
        return table.join(counts.select(key), key, "left_semi")
    return hot_join(table, counts.select(key), [key], "left_semi", hot=counts.filter(F.col("count") >= cut))


def _different(buckets: DataFrame) -> DataFrame:
    """One of all buckets with the same members: two near copies share most of their sketches, and one meeting is enough.

    Members are told by their number and two 64-bit sums of their hashes.
    """
    sums = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"sum{seed}") for seed in (0, 1)]
    same = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("crowd"), *sums).groupBy("crowd", "sum0", "sum1")
    return hot_join(buckets, stage(same.agg(F.min("bucket").alias("bucket")).select("bucket"), "different"), ["bucket"], "left_semi")


def shared_shingles(texts: DataFrame, k: int) -> DataFrame:
    """``(node, own, cells)``: how many shingles of a text no other of these texts has, and where the rest are.

    The rest is counted in ``CELLS`` classes by hash. Two texts have at most as many shingles in common as the smaller
    counts of all classes add up to.
    """
    hashes = texts.select("node", F.transform(F.split("joined", " "), lambda w: F.xxhash64(w)).alias("h"))
    grams, told = stage_told(hashes.mapInArrow(_grams(k), GRAMS), "grams")
    size = grams.groupBy("node").agg(F.sum("n").alias("size"))
    cell = F.pmod("gram", F.lit(CELLS)).cast("int").alias("cell")
    held = _repeated(grams, "gram", told["rows"]).groupBy("node", cell).agg(F.sum("n").cast("int").alias("n"))
    per_node = held.groupBy("node").agg(F.sum("n").alias("met"), F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("of"))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.coalesce(F.try_element_at("of", c), F.lit(0)))
    return size.join(per_node, "node", "left").select(
        "node", (F.col("size") - F.coalesce("met", F.lit(0))).cast("int").alias("own"), F.when(F.col("met") > 0, numbers).alias("cells")
    )


ALIGNED = "src bigint, dst bigint, gap int"


def _align(k: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs that are links, with their distance: shingles that one of the two has alone."""
        for batch in batches:
            good, gaps = [], []
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                known: dict = {}
                grams = []
                for text in (left[i].as_py(), right[i].as_py()):
                    ws = text.split(" ")
                    n = min(k, len(ws))
                    grams.append([known.setdefault(g, len(known)) for g in zip(*(ws[j: len(ws) - n + 1 + j] for j in range(n)))])
                whole, found = len(grams[0]) + len(grams[1]), ordered_similarity(*grams, similarity)
                good.append(found > 0)
                gaps.append(whole - 2 * round(whole * found / (1 + found)))
            table = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(good, pa.bool_()), pa.array(gaps, pa.int32())], names=["src", "dst", "good", "gap"])
            yield table.filter(table.column("good")).select(["src", "dst", "gap"])

    return run


def _links(buckets: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links ``(src, dst)`` between nodes that share a bucket; enough of them to connect every class."""
    spark = buckets.sparkSession
    nodes = stage(buckets.select(F.col("node").alias("id")).distinct(), "nodes")
    crowds = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("crowd"))
    central = stage(hot_join(buckets, stage(crowds, "crowds"), ["bucket"]).groupBy("node").agg(F.sum("crowd").alias("met")), "central")
    state = hot_join(buckets, central, ["node"]).select(
        "bucket", "node", "size", "met", F.col("node").alias("class"), F.lit(None).cast("int").alias("gap"),
        F.lit(0).alias("own"), F.lit(None).cast("array<int>").alias("cells"),
    )
    pair = [F.least("node", "l_node").alias("src"), F.greatest("node", "l_node").alias("dst")]
    most, links, pairs_done, known = 1, None, None, None
    while True:
        state = stage(state, "members")
        if state.isEmpty():
            break
        first = links is None
        # Round one: the most central member. Later: members outside the largest class, about ``most`` per bucket.
        if first:
            leaders = state.groupBy("bucket").agg(F.max_by(F.struct("node", "size", "class", "gap", "own", "cells"), F.struct("met", "node")).alias("l")).select("bucket", "l.*")
        else:
            chance = F.pmod(F.xxhash64(F.lit(most), "bucket", "node"), F.col("waiting"))
            leaders = state.filter("class != largest").filter(chance < most).select("bucket", "node", "size", "class", "gap", "own", "cells")
        leaders = stage(leaders.toDF("bucket", "l_node", "l_size", "l_class", "l_gap", "l_own", "l_cells"), "leaders")
        met = hot_join(state.select("bucket", "node", "size", "class", "gap", "own", "cells"), leaders, ["bucket"])
        fits = F.least("size", "l_size") >= similarity * F.greatest("size", "l_size") - 1e-9
        allowed = (F.col("size") + F.col("l_size")) * (1 - similarity) / (1 + similarity) + 1e-9
        near = F.coalesce(F.abs(F.col("gap") - F.col("l_gap")) <= allowed, F.lit(True))
        # Shingles in common are at most those that either text shares with any other one, class by class.
        most_common = F.least(F.col("size") - F.col("own"), F.col("l_size") - F.col("l_own"))
        by_class = F.aggregate(F.zip_with("cells", "l_cells", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
        needed = (F.col("size") + F.col("l_size")) * similarity / (1 + similarity) - 1e-9
        enough = (most_common >= needed) & F.coalesce(by_class >= needed, F.lit(True))
        pairs = met.filter((F.col("class") != F.col("l_class")) & fits & near & enough).select(*pair).distinct()
        if pairs_done is not None:
            pairs = pairs.join(pairs_done, ["src", "dst"], "left_anti")
        pairs = stage(pairs, "pairs")
        pairs_done = pairs if pairs_done is None else pairs_done.union(pairs)
        # A leader's text is needed once per pair; the pairs are dealt evenly before they are aligned.
        ids, told = stage_told(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "paired")
        paired = texts.join(F.broadcast(ids), "node", "left_semi") if told["rows"] <= FEW else texts
        left = hot_join(pairs, paired.select(F.col("node").alias("src"), F.col("joined").alias("left")), ["src"])
        both = hot_join(left, paired.select(F.col("node").alias("dst"), F.col("joined").alias("right")), ["dst"])
        aligned = stage(both.select("src", "dst", "left", "right").mapInArrow(_align(k, similarity), ALIGNED), "aligned")
        found = aligned.select("src", "dst")
        links = found if links is None else links.union(found)
        known = stage(connected_components(nodes, found) if known is None else extend_components(known, found), "classes")
        classes = known.select(F.col("id").alias("node"), F.col("component").alias("class"))
        if first:
            measured = hot_join(state.drop("gap"), leaders.select("bucket", "l_node"), ["bucket"]).select("*", *pair)
            measured = measured.join(aligned.select("src", "dst", "gap"), ["src", "dst"], "left")
            state = measured.withColumn("gap", F.when(F.col("node") == F.col("l_node"), 0).otherwise(F.col("gap"))).drop("src", "dst", "l_node")
        # A leader has met all members; what may be left are pairs of others in different classes.
        led = leaders.select("bucket", F.col("l_node").alias("node"))
        state = state.select("bucket", "node", "size", "met", "gap", "own", "cells").join(led, ["bucket", "node"], "left_anti")
        state = stage(state.join(classes, "node"), "members")
        # Buckets go on while a member is outside the largest class; one row per class and bucket is summed up.
        per_class = state.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
        per_bucket = per_class.groupBy("bucket").agg(F.max_by("class", F.struct("n", "class")).alias("largest"), (F.sum("n") - F.max("n")).alias("waiting"))
        state = hot_join(state, stage(per_bucket.filter("waiting > 0"), "waiting"), ["bucket"])
        if first:
            # What members share with any other text they may still meet; one with too little has no link left to find.
            state = stage(state, "contested")
            ids, told = stage_told(state.select("node").distinct(), "open")
            if not told["rows"]:
                break
            open_texts = texts.join(F.broadcast(ids) if told["rows"] <= FEW else ids, "node", "left_semi")
            state = hot_join(state.drop("own", "cells"), stage(shared_shingles(open_texts, k), "own"), ["node"])
            state = state.filter(F.col("size") - F.col("own") >= similarity * F.col("size") - 1e-9)
        most *= 64
    return links if links is not None else spark.createDataFrame([], "src long, dst long")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY,
            sketches: int = SKETCHES, taken: int = TAKEN) -> DataFrame:
    """Per row of ``docs``: node (hash of its words), doc_id, class_id, class_size, kept.

    ``kept`` marks the row with the smallest doc_id of each class; rows that repeat it are marked too.
    """
    multipliers = np.random.default_rng(11).integers(1, 1 << 63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    body = F.col(f"`{text}`")
    name = F.col(f"`{doc_id}`").cast("long").alias("doc_id")
    hashed = docs.select(words(body).alias("w"), name).select(
        F.xxhash64(F.array_join("w", " ")).alias("node"), "doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("h")
    )
    rows = stage(hashed.mapInArrow(_sketches(multipliers, k, taken, similarity), SKETCHED), "sketches")
    first = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    first = stage(first, "copies")
    copied, told = stage_told(first.filter("n > 1").select("node"), "copied")
    keyed = rows.select("node", "size", "keys")
    if told["rows"] <= FEW:
        # Only rows of texts that occur twice have to meet.
        marks = F.broadcast(copied)
        keyed = keyed.join(marks, "node", "left_anti").unionByName(keyed.join(marks, "node", "left_semi").dropDuplicates(["node"]))
    else:
        keyed = keyed.dropDuplicates(["node"])
    members, told = stage_told(keyed.select(F.explode(F.array_distinct("keys")).alias("bucket"), "node", "size"), "members")
    buckets = stage(_different(stage(_repeated(members, "bucket", told["rows"]), "repeated")), "buckets")

    # The words of every node in a shared bucket, from the row with its smallest id; copies are spread by id.
    low = F.coalesce("doc_id", F.lit(-(1 << 62))).alias("at")
    wanted = stage(buckets.select("node").distinct().join(first.select("node", "doc_id"), "node").select("node", low), "wanted")
    source = docs.select(body.alias("body"), name).select("body", low)
    ids = wanted.select("at").distinct()
    # Words are taken of the rows wanted only.
    source = source.join(F.broadcast(ids), "at", "left_semi") if wanted.count() <= FEW else hot_join(source, stage(ids, "ids"), ["at"], "left_semi")
    source = source.select("at", _joined(F.col("body")).alias("joined")).withColumn("node", F.xxhash64("joined"))
    # A node is wanted once: dealt out by node alone, by a range as Spark makes an equality a key, the texts move once.
    chosen = wanted.select("node", F.col("at").alias("of"))
    texts = source.join(chosen, "node").filter("at between of and of").select("node", "joined")
    texts = stage(texts.dropDuplicates(["node"]), "texts")

    links = stage(_links(buckets, texts, k, similarity), "links")
    named = connected_components(first.select(F.col("node").alias("id")), links).select(F.col("id").alias("node"), F.col("component").alias("class"))
    placed = stage(first.join(named, "node"), "named")
    per_class = placed.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    told = stage(hot_join(placed.select("node", "class"), stage(per_class, "per-class"), ["class"]).drop("class"), "told")
    return hot_join(rows.select("node", "doc_id"), told, ["node"]).select(
        "node", "doc_id", "class_id", "class_size", F.expr("doc_id <=> class_id").alias("kept")
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one of each class, that of its smallest doc_id."""
    keep = classes(docs, doc_id, text, **options).filter("kept").select("node", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("at")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    at = F.coalesce(F.col(f"_doc.`{doc_id}`").cast("long"), F.lit(-(1 << 62)))
    rows = whole.select("_doc", _node(F.col(f"_doc.`{text}`")).alias("node"), at.alias("at")).join(keep, ["node", "at"])
    return rows.dropDuplicates(["node", "at"]).select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
