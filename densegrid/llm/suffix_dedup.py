"""Repeated byte strings by a suffix array over sampled suffixes.

A string of ``length`` bytes counts as repeated when it starts anywhere else too, in the same text or in another. Every
byte that a repeated string covers goes, at all its places.

Suffixes are sampled by content: among the ``width`` first places of a string the one whose next 16 bytes have the
smallest hash (the first of equals) is its *anchor*. Equal strings have their anchor at the same place, so the strings
of one anchor, a *stretch* of consecutive starts, only ever equal strings of anchors with the same *lead*, the
``length - width + 1`` bytes from the anchor on, which lie in all of them. Then

1. leads are counted by hash; a stretch whose lead occurs once holds nothing repeated and stays where it is;
2. equal stretches become one row with a count before they move, so a passage that a third of all texts share is a few
   rows;
3. the suffixes at the anchors are range-partitioned by their lead, with splitters that Spark samples. A bucket sorts
   them by multikey quicksort (a character is eight bytes; one step serves all open groups) to the right of the anchor
   and, within a lead, to the left of it, and keeps the common lengths of neighbours. Strings with ``o`` bytes before
   the anchor are equal exactly if neighbours agree on ``length - o`` bytes to the right and ``o`` to the left, which
   two passes over the common lengths tell for every ``o``;
4. equal leads never lie on both sides of a splitter, so across a boundary there is nothing left to compare. What that
   costs is that a lead may be too crowded for a bucket: more than ``CROWD`` different stretches. Its stretches are
   cut into narrower ones, whose longer leads tell more of them apart, and sorted anew, down to single strings.

Stretches and leads go by 64-bit hashes each, texts by 128 bits. Null text counts as empty; a text below ``length``
bytes keeps all of them; rows that repeat a text are places of their own, so all of its strings are repeated; null ids
stay as they are; other columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegrid.runtime import hot_join, stage

LENGTH = 400
#: Starts per anchor at most, a power of two, and the narrower widths for crowded leads. The last one must be 1.
WIDTHS = (256, 32, 4, 1)
GRAM = 16
#: Starts of one text that are looked at together.
PIECE = 1 << 16
#: Different stretches of a lead that one bucket takes, and rows of a bucket.
CROWD, BUCKET = 16_384, 32_768
#: Rows of a set of keys that is broadcast to keep other rows from moving; a larger set is joined by a shuffle.
FEW = 1_000_000


def stretches(data: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of starts and distance to the anchor of every stretch of a text."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    padded = np.concatenate([data, np.zeros(GRAM + 8, np.uint8)])
    word = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    found = []
    for at in range(0, n, PIECE):
        m = min(PIECE, n - at)
        g = m + width - 1
        value = word[at: at + g] * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        value += word[at + 8: at + 8 + g]
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(32)
        place = np.arange(g, dtype=np.int32)
        step = 1
        while step < width:
            place = np.where(value[:-step] <= value[step:], place[:-step], place[step:])
            value = np.minimum(value[:-step], value[step:])
            step *= 2
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        found.append((at + first, np.diff(np.r_[first, m]), place[first] - first))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _names(body: bytes, start: int, n: int, off: int, length: int, width: int) -> tuple[int, int]:
    """Hashes of the lead and of the whole stretch."""
    anchor = start + off
    lead = xxhash.xxh3_64_intdigest(body[anchor: anchor + length - width + 1])
    return lead, xxhash.xxh3_64_intdigest(body[start: start + n - 1 + length], seed=off * 65536 + n)


SCANNED = "doc_id bigint, n_bytes bigint, sha binary, lead array<bigint>, stretch array<bigint>, start array<int>, n array<int>, off array<int>"


def _scan(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield one(batch.slice(at, 512))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, shas, leads, names, ends = [], [], [], [], [0]
        parts: list[list[np.ndarray]] = [[], [], []]
        for text in batch.column(1):
            body = text.as_py() or b""
            sizes.append(len(body))
            shas.append(hashlib.sha256(body).digest())
            start, n, off = stretches(np.frombuffer(body, np.uint8), length, width)
            for s, k, o in zip(start.tolist(), n.tolist(), off.tolist()):
                lead, name = _names(body, s, k, o, length, width)
                leads.append(lead)
                names.append(name)
            ends.append(len(leads))
            for part, x in zip(parts, (start, n, off)):
                part.append(x)
        cuts = pa.array(ends, pa.int32())
        lists = [_signed(leads), _signed(names), *(pa.array(np.concatenate(p).astype(np.int32)) for p in parts)]
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary())]
        return pa.RecordBatch.from_arrays(
            [*columns, *(pa.ListArray.from_arrays(cuts, x) for x in lists)],
            names=["doc_id", "n_bytes", "sha", "lead", "stretch", "start", "n", "off"],
        )

    return run


SUFFIX = "lead bigint, stretch bigint, copies bigint, n int, off int, right binary, left binary"


def _suffix(body: bytes, start: int, n: int, off: int, length: int, width: int) -> tuple[bytes, bytes]:
    """What stands from the anchor on and, backwards, before it, filled up with zeros."""
    anchor, low = start + off, off - n + 1
    return body[anchor: anchor + length - low].ljust(length, b"\0"), body[start:anchor][::-1].ljust(width, b"\0")


def _cut(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with the stretches wanted of them -> suffixes."""
        for batch in batches:
            for i in range(batch.num_rows):
                body, rows = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for at in range(0, len(rows), 4096):
                    part = rows[at: at + 4096]
                    sides = [_suffix(body, r["start"], r["n"], r["off"], length, width) for r in part]
                    yield pa.RecordBatch.from_arrays([
                        *(pa.array([r[c] for r in part], pa.int64()) for c in ("lead", "stretch", "copies")),
                        *(pa.array([r[c] for r in part], pa.int32()) for c in ("n", "off")),
                        *(pa.array(x, pa.binary()) for x in zip(*sides)),
                    ], names=["lead", "stretch", "copies", "n", "off", "right", "left"])

    return run


NARROWED = "up_lead bigint, up_stretch bigint, shift int, " + SUFFIX


def _narrow(length: int, wide: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of up to ``wide`` starts -> stretches of up to ``width`` starts."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = [x for row in batch.slice(at, 256).to_pylist() for x in cut(row)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), kinds)],
                    names=["up_lead", "up_stretch", "shift", "lead", "stretch", "copies", "n", "off", "right", "left"],
                )

    long, short, raw = pa.int64(), pa.int32(), pa.binary()
    kinds = [long, long, short, long, long, long, short, short, raw, raw]

    def cut(row: dict) -> Iterator[tuple]:
        off, low = row["off"], row["off"] - row["n"] + 1
        body = row["left"][:off][::-1] + row["right"][: length - low]
        for shift in range(low // width * width, off + 1, width):
            most, least = min(off, shift + width - 1), max(low, shift)
            start, n = off - most, most - least + 1
            lead, name = (int(np.uint64(x).view(np.int64)) for x in _names(body, start, n, most - shift, length, width))
            yield (row["lead"], row["stretch"], shift, lead, name, row["copies"], n, most - shift,
                   *_suffix(body, start, n, most - shift, length, width))

    return run


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of big-endian words, and the bytes that each row in it has in common with the one before.

    Multikey quicksort: rows are parted by one eight-byte character, equal ones go on with the next. All groups that
    are still open take a step together.
    """
    n, k = words.shape
    order, common = np.arange(n), np.full(n, 8 * k)
    common[:1] = 0
    live, group = np.arange(n), np.zeros(n, np.int64)
    for at in range(k):
        if len(live) < 2:
            break
        value = words[order[live], at]
        by = np.lexsort((value, group))
        order[live], value = order[live][by], value[by]
        same = group[1:] == group[:-1]
        parted = same & (value[1:] != value[:-1])
        gap = value[1:][parted] ^ value[:-1][parted]
        equal = sum((gap < np.uint64(1 << s)).astype(np.int64) for s in range(8, 64, 8))
        common[live[1:][parted]] = 8 * at + equal
        group = np.r_[0, np.cumsum(~same | parted)]
        stay = np.bincount(group)[group] > 1
        live, group = live[stay], group[stay]
    return order, common


def repeated(right: np.ndarray, left: np.ndarray, off: np.ndarray, n: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """For suffixes with whole groups of leads: whether the string with ``o`` bytes before the anchor is repeated.

    ``right`` and ``left`` are bytes, one row each; the result has a row per suffix and a column per ``o``.
    """
    rows, width = left.shape
    wide = np.zeros((rows, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = left
    ahead = np.zeros((rows, -(-length // 8) * 8), np.uint8)
    ahead[:, :length] = right
    order, common = multikey_order(ahead.view(">u8").astype(np.uint64))
    lead = np.empty(rows, np.uint64)
    lead[order] = np.cumsum(common < length - width + 1)
    back_order, back_common = multikey_order(np.concatenate([lead[:, None], wide.view(">u8").astype(np.uint64)], axis=1))
    back_common -= 8  # below zero between two leads
    found = np.zeros((rows, width), bool)
    to_right, to_left = np.empty(rows, np.int64), np.empty(rows, np.int64)
    for o in range(width):
        here = np.flatnonzero((off - n < o) & (o <= off))
        to_right[order] = np.cumsum(common < length - o)
        to_left[back_order] = np.cumsum(back_common < o)
        _, kind, count = np.unique(to_right[here] * (rows + 1) + to_left[here], return_inverse=True, return_counts=True)
        found[here, o] = (count[kind] > 1) | (copies[here] > 1)
    return found


def _sort_bucket(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        sides = [np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(-1, w) for c, w in (("right", length), ("left", width))]
        off, n, copies = (table.column(c).to_numpy() for c in ("off", "n", "copies"))
        bits = np.packbits(repeated(*sides, off, n, copies, length), axis=1, bitorder="little")
        any_of = bits.any(axis=1)
        yield from table.select(["lead", "stretch"]).append_column("bits", pa.array([b.tobytes() for b in bits], pa.binary())).filter(pa.array(any_of)).to_batches()

    return run


FOUND = "lead bigint, stretch bigint, bits binary"


def _widen(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Put the bits of narrow stretches where they belong in the wide one."""
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                whole = 0
                for part in parts:
                    whole |= int.from_bytes(part["bits"], "little") << part["shift"]
                out.append(whole.to_bytes(-(-width // 8), "little"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["lead", "stretch", "bits"])

    return run


def sorted_buckets(suffixes: DataFrame, length: int, width: int, rows: int) -> DataFrame:
    """``(lead, stretch, bits)`` of the suffixes that have a repeated string, from sorted buckets."""
    key = F.substring("right", 1, length - width + 1)
    buckets = suffixes.withColumn("key", key).repartitionByRange(max(1, -(-rows // BUCKET)), "key").drop("key")
    return buckets.mapInArrow(_sort_bucket(length, width), FOUND)


def find_repeated(suffixes: DataFrame, length: int, widths: tuple[int, ...], crowd: int = CROWD) -> DataFrame:
    """``(lead, stretch, bits)``, bit ``o`` for the string with ``o`` bytes before the anchor; ``suffixes`` is staged."""
    width = widths[0]
    rows, most = suffixes.groupBy("lead").agg(F.count(F.lit(1)).alias("m")).agg(F.sum("m"), F.max("m")).first()
    if not rows:
        return suffixes.sparkSession.createDataFrame([], FOUND)
    if most <= crowd or width == 1:
        return stage(sorted_buckets(suffixes, length, width, rows), "found")
    crowded = stage(suffixes.groupBy("lead").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > crowd).select("lead"), "crowded")
    calm = stage(hot_join(suffixes, crowded, ["lead"], "left_anti", rows=rows), "calm")
    dense = hot_join(suffixes, crowded, ["lead"], "left_semi", rows=rows)
    parts = stage(dense.mapInArrow(_narrow(length, width, widths[1]), NARROWED), "narrow")
    # One row per different narrow stretch, then only leads with more than one place.
    merged = stage(parts.groupBy("lead", "stretch").agg(
        F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in ("n", "off", "right", "left")]
    ), "merged")
    shared = stage(merged.groupBy("lead").agg(F.sum("copies").alias("places")).filter("places > 1").select("lead"), "shared")
    deeper = find_repeated(stage(hot_join(merged, shared, ["lead"], "left_semi"), "shared_stretches"), length, widths[1:], crowd)
    back = hot_join(parts.select("up_lead", "up_stretch", "shift", "lead", "stretch"), deeper, ["lead", "stretch"])
    whole = back.groupBy(F.col("up_lead").alias("lead"), F.col("up_stretch").alias("stretch")).agg(
        F.collect_list(F.struct("shift", "bits")).alias("parts")
    )
    wide = whole.mapInArrow(_widen(width), FOUND)
    if calm.isEmpty():
        return stage(wide, "found")
    return stage(wide.unionByName(sorted_buckets(calm, length, width, rows)), "found")


CLEANED = "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _clean(length: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [one(part.column(1)[i].as_py(), part.column(2)[i].as_py()) for i in range(part.num_rows)]
                removed, spans, shas, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas), pa.array(kept, pa.binary())],
                    names=["key", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    def one(body: bytes, rows: list[dict]) -> tuple:
        change = np.zeros(len(body) + 1, np.int32)
        for r in rows:
            bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
            starts = r["start"] + r["off"] - np.flatnonzero(bits[r["off"] - r["n"] + 1: r["off"] + 1]) - (r["off"] - r["n"] + 1)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        spans = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[0])
        return int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest(), kept if texts else None

    return run


def _texts_of(bodies: DataFrame, keys: DataFrame) -> DataFrame:
    """One ``(key, body)`` per key wanted; copies of a text merge before they move."""
    if keys.count() <= FEW:
        bodies = bodies.join(F.broadcast(keys), "key", "left_semi")
    else:
        bodies = hot_join(bodies, keys, ["key"], "left_semi")
    return bodies.groupBy("key").agg(F.first("body").alias("body"))


def remove_repeated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, widths: tuple[int, ...] = WIDTHS,
    crowd: int = CROWD, texts: bool = False,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (UTF-8 bytes) with ``texts``.

    ``widths`` are powers of two that fall to 1, the first at most ``length - 15``.
    """
    if widths[0] + GRAM - 1 > length or widths[-1] != 1 or any(w & (w - 1) for w in widths):
        raise ValueError("widths should be powers of two that fall to 1, the first at most length - 15")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("body")
    name = F.col(f"`{doc_id}`").cast("bigint").alias("doc_id")
    key = F.substring("sha", 1, 16).alias("key")
    scanned = stage(docs.select(name, body).mapInArrow(_scan(length, widths[0]), SCANNED), "scanned")

    leads = scanned.select(F.explode("lead").alias("lead")).groupBy("lead").count().filter("count > 1").select("lead")
    leads = stage(leads, "leads")
    places = scanned.select(key, F.inline(F.arrays_zip("lead", "stretch", "start", "n", "off")))
    places = places.join(F.broadcast(leads), "lead", "left_semi") if leads.count() <= FEW else hot_join(places, leads, ["lead"], "left_semi")
    different = stage(places.groupBy("lead", "stretch").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "start")).alias("at"), F.first("n").alias("n"), F.first("off").alias("off")
    ), "stretches")

    bodies = docs.select(F.substring(F.unhex(F.sha2(body, 256)), 1, 16).alias("key"), body)
    wanted = different.groupBy("at.key").agg(F.collect_list(F.struct("lead", "stretch", "copies", "at.start", "n", "off")).alias("rows"))
    wanted = stage(wanted, "wanted")
    cut = _texts_of(bodies, wanted.select("key")).join(wanted, "key").select("body", "rows")
    suffixes = stage(cut.mapInArrow(_cut(length, widths[0]), SUFFIX), "suffixes")
    found = find_repeated(suffixes, length, widths, crowd)

    hits = hot_join(places.distinct(), found, ["lead", "stretch"]).groupBy("key").agg(F.collect_list(F.struct("start", "n", "off", "bits")).alias("rows"))
    hits = stage(hits, "hits")
    whole = _texts_of(bodies, hits.select("key")).join(hits, "key").select("key", "body", "rows")
    cleaned = stage(whole.mapInArrow(_clean(length, texts), CLEANED), "cleaned")
    rows = scanned.select("doc_id", "n_bytes", F.lower(F.hex("sha")).alias("sha"), key)
    # Whole texts are never broadcast; with them Spark splits a skewed key by itself.
    joined = rows.join(cleaned, "key", "left") if texts else hot_join(rows, cleaned, ["key"], "left")
    out = joined.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "key", "kept",
    )
    if not texts:
        return out.drop("key", "kept")
    unchanged = out.filter("kept is null").drop("kept")
    back = unchanged.join(_texts_of(bodies, unchanged.select("key").distinct()).withColumnRenamed("body", "kept"), "key")
    return out.filter("kept is not null").unionByName(back).drop("key")
