"""Stupid-backoff scores of a word bigram model: count tables partitioned by hash, joined to exploded n-grams.

``S(v | w) = c(w v) / c(w)`` where the bigram was counted, else ``alpha * c(v) / N``; the first word of a document has
``c(w) / N``. A document's score is the sum of ``ln S`` over its words. Words are runs of 0-9, a-z and characters
beyond ASCII after lower-casing A-Z; n-grams go by 64-bit hashes. A document without words has score 0 and 0 words;
null text counts as empty. A word that no table has counts as seen once, as a backoff needs some value.

Two ways to the same numbers:

- ``count_tables`` and ``score``: tables as DataFrames, any documents against them, with backoff, as plain joins.
- ``score_corpus``: all documents against the counts of these documents. No n-gram of theirs is missing from the
  tables, so every word takes the bigram branch and the sum falls apart into bigram terms ``ln c(w v)`` and word
  terms ``-ln c(w)``, which need not meet per word. Each occurrence is then sent once, eight bytes, to the partition
  that owns its hash; that partition holds the table of its n-grams, joins it to the occurrences and adds up per
  document. Words and bigrams frequent enough to make a partition uneven (a bounded number, by their share of all
  words) are counted first, and joined where the documents are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densegrid.llm.text import words
from densegrid.runtime import stage

#: A word is frequent with one in so many of all words, a bigram likewise: at most so many are broadcast.
FREQUENT_WORDS, FREQUENT_BIGRAMS = 500_000, 20_000
#: Occurrences that one hash partition should own.
PART_GRAMS = 1_500_000


# --- tables and plain joins -----------------------------------------------------------------------------------------


def _hashed(text: str) -> Column:
    return F.transform(words(F.col(f"`{text}`")), lambda w: F.xxhash64(w))


def _exploded(docs: DataFrame, text: str) -> DataFrame:
    """``(row, word, before)``: every word hash of every document, ``before`` null for the first."""
    ids = docs.select("row", _hashed(text).alias("w"))
    return ids.select("row", "w", F.posexplode("w").alias("at", "word")).select(
        "row", "word", F.when(F.col("at") > 0, F.element_at("w", F.greatest("at", F.lit(1)))).alias("before")
    )


def count_tables(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(word, n)`` and ``(before, word, n)`` over all documents, each partitioned by the hash of its n-gram."""
    grams = _exploded(docs.withColumn("row", F.lit(0)), text)
    unigrams = grams.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    bigrams = grams.filter("before is not null").groupBy("before", "word").agg(F.count(F.lit(1)).alias("n"))
    return stage(unigrams, "unigrams"), stage(bigrams, "bigrams")


def score(docs: DataFrame, unigrams: DataFrame, bigrams: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = 0.4) -> DataFrame:
    """``(doc_id, n_words, score)`` of any documents against given tables.

    Equal n-grams of a document are summed before the joins. For a table whose words are very uneven rely on the
    skew handling of joins (AQE); ``score_corpus`` handles it by itself.
    """
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "scored")
    total = float(unigrams.agg(F.sum("n")).first()[0] or 1)
    grams = _exploded(rows, "text").groupBy("row", "before", "word").agg(F.count(F.lit(1)).alias("times"))
    bi = bigrams.select("before", "word", F.col("n").alias("both"))
    first = unigrams.select(F.col("word").alias("before"), F.col("n").alias("context"))
    last = unigrams.select("word", F.col("n").alias("own"))
    joined = grams.join(bi, ["before", "word"], "left").join(first, "before", "left").join(last, "word", "left")
    lone = F.coalesce("own", F.lit(1)) / F.lit(total)
    each = F.when(F.col("before").isNull(), lone).when(F.col("both").isNotNull(), F.col("both") / F.col("context")).otherwise(alpha * lone)
    sums = joined.groupBy("row").agg(F.sum("times").alias("n_words"), F.sum(F.log(each) * F.col("times")).alias("score"))
    return rows.select("row", "doc_id").join(sums, "row", "left").select(
        "doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


# --- all documents against their own counts -------------------------------------------------------------------------


def _pairs(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the neighbours inside documents, and the place of each one's second word."""
    inside = np.ones(len(ids), bool)
    inside[ends[:-1][ends[:-1] < len(ids)]] = False
    at = np.flatnonzero(inside)
    a, b = ids.view(np.uint64)[at - 1], ids.view(np.uint64)[at]
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x7F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64), at


def _tokens(batch: pa.RecordBatch, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, word hashes and document ends of a batch, in pieces of about ``most`` words."""
    lists = batch.column(1)
    rows, ends = batch.column(0).to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy()
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        stop = min(stop, len(rows))
        yield rows[start:stop], values[ends[start]: ends[stop]], ends[start: stop + 1] - ends[start]
        start = stop


def _add_up(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(ids, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


COUNTS = "kind int, id bigint, n bigint"


def _count(share: int, known_pairs=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: words. Kind 1: bigrams that are frequent in a piece, or all those asked for. Kind 2: documents."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(kind, ids, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), pa.array(n)], names=["kind", "id", "n"])

        for batch in batches:
            if known_pairs is None:
                yield out(2, np.zeros(1, np.int64), np.array([batch.num_rows]))
            for _, ids, ends in _tokens(batch):
                pairs, _ = _pairs(ids, ends)
                if known_pairs is not None:
                    wanted = known_pairs.value
                    at = np.searchsorted(wanted, pairs)
                    hit = pairs[wanted[np.minimum(at, len(wanted) - 1)] == pairs] if len(wanted) else pairs[:0]
                    held.append(_add_up(hit, np.ones(len(hit), np.int64)))
                else:
                    keys, n = np.unique(pairs, return_counts=True)
                    often = n * share >= len(ids)
                    if often.any():
                        yield out(1, keys[often], n[often])
                    held.append(_add_up(ids, np.ones(len(ids), np.int64)))
                if len(held) > 1 and sum(len(k) for k, _ in held) > 1_500_000:
                    held = [_add_up(*map(np.concatenate, zip(*held)))]
                    if len(held[0][0]) > 1_000_000:
                        yield out(0, *held.pop())
        if held:
            yield out(0 if known_pairs is None else 1, *_add_up(*map(np.concatenate, zip(*held))))

    return run


PACKED = "part int, kind int, docs binary, times binary, sums binary, grams binary"


def _lookup(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """ln count of each id, NaN if the table does not have it."""
    keys, logs = table
    if not len(keys):
        return np.full(len(ids), np.nan)
    at = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
    return np.where(keys[at] == ids, logs[at], np.nan)


def _pack(frequent, parts: int, total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Score what the broadcast tables know; send every other occurrence to the partition of its hash.

        A row of kind 1 (bigrams) or 0 (words) has documents, how many of its grams belong to each, the weight of
        their ln count, and the grams. A row of kind 2 has documents with a finished part of their sums and their ids.
        """
        word_table, pair_table = frequent.value
        piece = 0

        def send(kind, doc, weight, grams, rows):
            """Pack by partition; in each, by document and weight."""
            part = ((grams.view(np.uint64) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, doc, weight, grams = part[order], doc[order], weight[order], grams[order]
            cuts = np.r_[np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
            start = 0
            for end in cuts.tolist():
                d, w = doc[start:end], weight[start:end]
                new = np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])]
                first = np.flatnonzero(new)
                yield (int(part[start]), kind, rows[d[first]].tobytes(), np.diff(np.r_[first, end - start]).astype(np.int32).tobytes(),
                       w[first].astype(np.int8).tobytes(), grams[start:end].tobytes())
                start = end

        for batch in batches:
            names = batch.column(2).fill_null(NO_ID).to_numpy()
            for rows, ids, ends in _tokens(batch):
                own, names = names[: len(rows)], names[len(rows):]
                n = np.diff(ends)
                doc = np.repeat(np.arange(len(rows)), n)
                pairs, second = _pairs(ids, ends)
                out = []
                sums = np.where(n > 0, -math.log(total), 0.0)
                # ln c(first) cancels as a numerator and as a context; the last word is no context.
                weight = np.full(len(ids), -1, np.int8)
                weight[ends[:-1][n > 0]] = 0
                weight[ends[1:][n > 0] - 1] = 0
                weight[ends[:-1][n == 1]] = 1
                logs = _lookup(word_table, ids)
                rare = np.isnan(logs)
                sums += np.bincount(doc, np.where(rare, 0.0, logs) * weight, len(rows))
                if rare.any():
                    out += send(0, doc[rare], weight[rare], ids[rare], rows)
                pair_doc, logs = doc[second], _lookup(pair_table, pairs)
                rare = np.isnan(logs)
                sums += np.bincount(pair_doc, np.where(rare, 0.0, logs), len(rows))
                if rare.any():
                    out += send(1, pair_doc[rare], np.ones(rare.sum(), np.int8), pairs[rare], rows)
                piece += 1
                out.append(((int(rows[0]) + piece) % parts, 2, rows.tobytes(), n.astype(np.int32).tobytes(), sums.tobytes(), own.tobytes()))
                types = [pa.int32(), pa.int32()] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["part", "kind", "docs", "times", "sums", "grams"])

    return run


PARTIAL = "part int, docs binary, ids binary, times binary, sums binary"
SUMS = "doc_id bigint, n_words bigint, score double"
#: Stands for a null doc_id on the way, and for one that another partial sum knows.
NO_ID = -(1 << 63)
#: Documents that one partition adds up, and partial sums that a task holds before it folds them.
PART_DOCS, FOLD = 50_000, 3_000_000


def _fold(rows: np.ndarray, ids: np.ndarray, n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Partial sums, one per document."""
    keys, at = np.unique(rows, return_inverse=True)
    known = np.full(len(keys), NO_ID)
    np.maximum.at(known, at, ids)
    return keys, known, np.bincount(at, n, len(keys)).astype(np.int64), np.bincount(at, sums, len(keys))


def _join(doc_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The count table of each owned hash partition, joined to the occurrences sent to it, summed per document."""
        held: dict[tuple[int, int], list] = {}
        partial: list[tuple[np.ndarray, ...]] = []

        def send():
            rows, *rest = _fold(*map(np.concatenate, zip(*partial)))
            partial.clear()
            part = (rows.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(doc_parts)
            columns = [[] for _ in range(5)]
            for p in np.unique(part):
                mine = part == p
                for column, value in zip(columns, (int(p), *(x[mine].tobytes() for x in (rows, *rest)))):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int32()] + [pa.binary()] * 4)]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "docs", "ids", "times", "sums"])

        for batch in batches:
            for part, kind, docs, times, sums, grams in zip(*(c.to_pylist() for c in batch.columns)):
                rows, times = np.frombuffer(docs, np.int64), np.frombuffer(times, np.int32)
                if kind == 2:
                    partial.append((rows, np.frombuffer(grams, np.int64), times, np.frombuffer(sums)))
                else:
                    held.setdefault((part, kind), []).append((rows, times, np.frombuffer(sums, np.int8), np.frombuffer(grams, np.int64)))
        while held:
            _, chunks = held.popitem()
            rows, times, weight, grams = map(np.concatenate, zip(*chunks))
            _, at, n = np.unique(grams, return_inverse=True, return_counts=True)
            sums = np.add.reduceat(np.log(n)[at], np.r_[0, np.cumsum(times)[:-1]]) * weight
            partial.append((rows, np.full(len(rows), NO_ID), np.zeros(len(rows), np.int32), sums))
            if sum(len(p[0]) for p in partial) > FOLD:
                yield send()
        if partial:
            yield send()

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partial sums of the documents of a partition, added up."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for _, rows, ids, n, sums in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(tuple(np.frombuffer(x, t) for x, t in ((rows, np.int64), (ids, np.int64), (n, np.int64), (sums, float))))
            if sum(len(x[0]) for x in held) > FOLD:
                held = [_fold(*map(np.concatenate, zip(*held)))]
    if held:
        _, ids, n, sums = _fold(*map(np.concatenate, zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(n), pa.array(sums)], names=["doc_id", "n_words", "score"])


def _table(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = df.select("id", "n").orderBy("id").toArrow()
    return found.column("id").to_numpy(), np.log(found.column("n").to_numpy().astype(float))


def score_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent_words: int = FREQUENT_WORDS,
                 frequent_bigrams: int = FREQUENT_BIGRAMS, part_grams: int = PART_GRAMS) -> DataFrame:
    """``(doc_id, n_words, score)`` of all documents against the counts over all of them; doc_id is a whole number.

    Rows are numbered inside one scan only, so a repeated doc_id gives rows of its own.
    """
    spark = docs.sparkSession
    row = F.monotonically_increasing_id().alias("row")
    tokens = docs.select(row, _hashed(text).alias("w"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"))
    counted = stage(tokens.mapInArrow(_count(2 * frequent_bigrams), COUNTS).groupBy("kind", "id").agg(F.sum("n").alias("n")), "counts")
    total = counted.filter("kind = 0").agg(F.sum("n")).first()[0] or 1
    # A bigram with a share of 1/frequent_bigrams has at least half of it in pieces where it was frequent.
    seen = counted.filter((F.col("kind") == 1) & (F.col("n") * 2 * frequent_bigrams >= total)).select("id").orderBy("id").toArrow()
    asked = spark.sparkContext.broadcast(seen.column("id").to_numpy())
    exact = tokens.mapInArrow(_count(0, asked), COUNTS).groupBy("id").agg(F.sum("n").alias("n"))
    frequent = spark.sparkContext.broadcast((
        _table(counted.filter((F.col("kind") == 0) & (F.col("n") * frequent_words >= total))), _table(exact)
    ))
    parts = max(1, -(-total // part_grams))
    doc_parts = max(1, -(-(counted.filter("kind = 2").agg(F.sum("n")).first()[0] or 1) // PART_DOCS))
    packed = tokens.mapInArrow(_pack(frequent, parts, float(total)), PACKED)
    partial = packed.repartition(parts, "part").mapInArrow(_join(doc_parts), PARTIAL)
    return partial.repartition(doc_parts, "part").mapInArrow(_add, SUMS)
