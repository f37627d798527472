"""Quality classifier by co-training of two views of a document.

One view is the text (shares of character classes, word and line statistics), the other the metadata (language,
source and the recorded length). Each has its own logistic model. Round zero fits both on the labelled documents.
In each further round a view takes in the unlabelled documents of which the other view is confident, with the other
view's answer as label. At the end each view is calibrated on labelled documents that no fit has seen, and the two
calibrated log-odds are combined by a third small model. Every document is scored.

Fits run over all rows: a step is one pass that adds up gradient and curvature per task and then in Spark; only the
sums, whose size is fixed by the number of features, reach the driver.

Null text counts as empty; an empty text has text features of zero. Null metadata is a value of its own. A document
labelled more than once has its majority label, and none on a tie. Without labelled documents of both classes there
is no model: scores are null and everything is kept. Repeated rows are scored like any others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densegrid.runtime import stage

#: Least quality of a document that is kept.
LEAST = 0.5
LANGS, SOURCES, LENGTHS = 16, 64, 24
META = 1 + LANGS + SOURCES + LENGTHS


def _classes() -> np.ndarray:
    """Byte classes whose shares are features, one row each."""
    groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n", b"!", b".,;:?", b"|",
              b"#$%&*@^~", b"()[]{}<>", b"'\"`", b"+-=/\\_", bytes(range(128, 256))]
    out = np.zeros((len(groups), 256))
    for i, g in enumerate(groups):
        out[i, list(g)] = 1
    return out


BYTES = _classes()
TEXT = 1 + len(BYTES) + 8


def text_features(text: str) -> np.ndarray:
    """Bias, byte class shares, then word and line statistics, all of the order of one."""
    out = np.zeros(TEXT)
    out[0] = 1.0
    words = text.split()
    if not words:
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out[1: 1 + len(BYTES)] = 4 * np.sqrt(BYTES @ np.bincount(raw, minlength=256) / len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    ended = sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines)
    out[1 + len(BYTES):] = (
        math.log1p(len(words)) / 10, distinct / len(words), math.log1p(distinct) / math.log1p(len(words)),
        min(len(text) / len(words), 40) / 10, len(set(lines)) / len(lines), ended / len(lines),
        math.log1p(len(lines)) / 10, math.log1p(len(text) / len(lines)) / 10,
    )
    return out


FEATURES = "doc_id bigint, x array<float>, m array<int>"


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        x = np.array([text_features(texts[i].as_py()) for i in range(batch.num_rows)], np.float32).reshape(-1, TEXT)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), TEXT).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["doc_id", "x", "m"])


def _views(docs: DataFrame) -> list[Column]:
    """Columns ``doc_id, text, m`` with m the places of the metadata ones; any missing column counts as null."""
    def column(name: str, kind: str):
        return F.col(f"`{name}`").cast(kind) if name in docs.columns else F.lit(None).cast(kind)

    def bucket(name: str, n: int):
        return F.coalesce(F.pmod(F.xxhash64(F.lower(column(name, "string"))), F.lit(n - 1)) + 1, F.lit(0))

    length = F.coalesce(F.least(F.floor(F.log2(F.greatest(column("n_chars", "long"), F.lit(0)) + 1)) + 1, F.lit(LENGTHS - 1)), F.lit(0))
    source = F.when(column("source", "string").isNull(), 0).otherwise(bucket("source", SOURCES))
    lang = F.when(column("lang", "string").isNull(), 0).otherwise(bucket("lang", LANGS))
    places = F.array(*[p.cast("int") for p in (lang + 1, source + 1 + LANGS, length + 1 + LANGS + SOURCES)])
    return [column("doc_id", "long").alias("doc_id"), F.coalesce(column("text", "string"), F.lit("")).alias("text"), places.alias("m")]


def features(docs: DataFrame) -> DataFrame:
    """The staged feature table, about 100 bytes a document."""
    return stage(docs.select(*_views(docs)).mapInArrow(_featurize, FEATURES), "quality-features")


def _one_hot(m: np.ndarray) -> np.ndarray:
    out = np.zeros((len(m), META))
    out[:, 0] = 1
    np.put_along_axis(out, m, 1.0, 1)
    return out


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    return (batch.column("x").flatten().to_numpy().reshape(n, -1).astype(float), _one_hot(batch.column("m").flatten().to_numpy().reshape(n, -1)))


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _sums(designs, labels, weights, betas):
    """Gradient and curvature of each design at its coefficients, as one flat array."""
    out = []
    for x, y, w, beta in zip(designs, labels, weights, betas):
        p = _probability(x @ beta)
        out += [x.T @ (w * (y - p)), ((x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x).ravel()]
    return np.concatenate(out)


def _newton(rows: DataFrame, design, betas: list[np.ndarray], steps: int, ridge: float) -> list[np.ndarray]:
    """Newton steps of several logistic models at once. ``design(batch)`` gives designs, labels and weights."""
    betas = [b.copy() for b in betas]
    for _ in range(steps):
        now = [b.copy() for b in betas]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    total = total + _sums(*design(batch), now)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

        found = rows.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toArrow()
        flat, start, moved = found.column("v").to_numpy(), 0, 0.0
        for k, beta in enumerate(betas):
            d = len(beta)
            penalty = np.full(d, ridge)
            penalty[0] = 1e-6
            gradient = flat[start: start + d] - penalty * beta
            curvature = flat[start + d: start + d + d * d].reshape(d, d) + np.diag(penalty)
            start += d + d * d
            step = np.linalg.solve(curvature, gradient)
            step *= min(1.0, 8.0 / max(1e-12, np.abs(step).max()))
            betas[k] = beta + step
            moved = max(moved, np.abs(step).max())
        if moved < 1e-3:
            break
    return betas


def fit(table: DataFrame, labels: DataFrame, rounds: int = 2, sure: float = 0.95, ridge: float = 1.0) -> dict | None:
    """Co-trained model from the feature table and ``labels`` (doc_id, quality); None without both classes.

    ``rounds`` exchanges of pseudo-labels; a view hands over what it holds for at least ``sure`` likely, either way.
    One labelled document in five, by hash, is set aside for calibration.
    """
    votes = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("vote"))
    y = F.when(F.col("vote") > 0.5, 1.0).when(F.col("vote") < 0.5, 0.0)
    known = votes.select("doc_id", y.alias("y"), (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("aside")).filter("y is not null")
    rows = stage(table.join(known, "doc_id", "left"), "quality-rows")
    have = {(r["y"], r["aside"]) for r in rows.filter("y is not null").groupBy("y", "aside").count().collect()}
    if {y for y, aside in have if not aside} != {0.0, 1.0}:
        return None
    split = {y for y, aside in have if aside} == {0.0, 1.0}

    def observed(batch):
        label = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
        aside = batch.column("aside").fill_null(False).to_numpy(zero_copy_only=False) & split
        return label, ~np.isnan(label), aside

    def plain(batch):
        x, m = _arrays(batch)
        label, labelled, aside = observed(batch)
        use = (labelled & ~aside).astype(float)
        return (x, m), (np.nan_to_num(label),) * 2, (use, use)

    betas = _newton(rows.filter("y is not null"), plain, [np.zeros(TEXT), np.zeros(META)], 8, ridge)
    for _ in range(rounds):
        teachers = [b.copy() for b in betas]

        def exchanged(batch, teachers=teachers):
            x, m = _arrays(batch)
            label, labelled, aside = observed(batch)
            views, labels_, weights = (x, m), [], []
            for other in (1, 0):
                p = _probability(views[other] @ teachers[other])
                confident = ~labelled & ((p >= sure) | (p <= 1 - sure))
                labels_.append(np.where(labelled, np.nan_to_num(label), p >= 0.5))
                weights.append(((labelled & ~aside) | confident).astype(float))
            return views, labels_, weights

        betas = _newton(rows, exchanged, betas, 4, ridge)

    def logits(batch):
        x, m = _arrays(batch)
        label, labelled, aside = observed(batch)
        use = (labelled & (aside if split else labelled)).astype(float)
        return x @ betas[0], m @ betas[1], np.nan_to_num(label), use

    def single(batch):
        a, b, label, use = logits(batch)
        one = np.ones(len(a))
        return (np.c_[one, a], np.c_[one, b]), (label, label), (use, use)

    labelled = rows.filter("y is not null")
    scales = _newton(labelled, single, [np.array([0.0, 1.0])] * 2, 6, 1e-2)

    def both(batch):
        a, b, label, use = logits(batch)
        return (np.c_[np.ones(len(a)), scales[0][0] + scales[0][1] * a, scales[1][0] + scales[1][1] * b],), (label,), (use,)

    mixed = _newton(labelled, both, [np.array([0.0, 0.5, 0.5])], 6, 1e-2)
    return {"text": betas[0], "meta": betas[1], "scales": scales, "mixed": mixed[0]}


def _scores(model: dict, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = model["scales"][0][0] + model["scales"][0][1] * (x @ model["text"])
    b = model["scales"][1][0] + model["scales"][1][1] * (m @ model["meta"])
    return _probability(a), _probability(b), _probability(model["mixed"] @ np.stack([np.ones(len(a)), a, b]))


SCORES = "doc_id bigint, text_score double, meta_score double, quality double"


def score(table: DataFrame, model: dict | None) -> DataFrame:
    """Per row of the feature table: doc_id, both views' calibrated scores, their combination ``quality``."""
    if model is None:
        none = F.lit(None).cast("double")
        return table.select("doc_id", none.alias("text_score"), none.alias("meta_score"), none.alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scores(model, *_arrays(batch)) if batch.num_rows else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found)], names=["doc_id", "text_score", "meta_score", "quality"])

    return table.mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, model: dict | None, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, whose quality is at least ``least``; scored where they are read."""
    if model is None:
        return docs
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(whole, *_views(docs)[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            x = np.array([text_features(texts[i].as_py()) for i in range(batch.num_rows)]).reshape(-1, TEXT)
            m = _one_hot(batch.column("m").flatten().to_numpy().reshape(len(x), -1))
            good = pa.array(_scores(model, x, m)[2] >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good)], names=["_doc"])

    return rows.mapInArrow(run, rows.select("_doc").schema).select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
