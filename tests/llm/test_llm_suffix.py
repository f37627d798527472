"""Repeated byte strings against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from compare import DATA

from densegrid.llm import suffix_dedup
from densegrid.llm.queries import QUERIES

DOCS = "doc_id long, text string, sha string, key int, body string"


def brute(bodies, length):
    """Which bytes of every text go."""
    places = collections.Counter()
    for body in bodies:
        places.update(hash(body[p: p + length]) for p in range(len(body) - length + 1))
    gone = []
    for body in bodies:
        mask = np.zeros(len(body), bool)
        for p in range(len(body) - length + 1):
            if places[hash(body[p: p + length])] > 1:
                mask[p: p + length] = True
        gone.append(mask)
    return gone


def expected(bodies, length):
    for body, mask in zip(bodies, brute(bodies, length)):
        spans = int(np.count_nonzero(np.diff(np.r_[0, mask.astype(int)]) > 0))
        kept = np.frombuffer(body, np.uint8)[~mask].tobytes()
        yield len(body), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept


def compare(spark, texts, length, **options):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeated(docs, length=length, texts=True, **options).collect()}
    wanted = dict(enumerate(expected([(t or "").encode() for t in texts], length)))
    assert {k: (*v[:4], bytes(v[4])) for k, v in found.items()} == wanted


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}é" if rng.random() < 0.05 else f"w{rng.randrange(of)}" for _ in range(n))


def passages(seed):
    """Shared passages at odd places, near copies, copies, runs and periods, short and empty texts, nulls."""
    rng = random.Random(seed)
    shared = [words(rng, 60) for _ in range(4)]
    texts = [None, "", "short", "short", "x" * 3000, "x" * 900 + "y" + "x" * 700, "ab" * 900, "b" + "ab" * 500, words(rng, 30_000)]
    for i in range(40):
        texts.append(words(rng, rng.randrange(80)) + " " + rng.choice(shared) + " " + words(rng, rng.randrange(80)))
    for i in range(12):
        base = list(texts[rng.randrange(9, 40)])
        base[rng.randrange(len(base))] = "#"
        texts.append("".join(base))
    return texts + [texts[20]] * 5 + [texts[8][50_000:90_000]]


@pytest.mark.parametrize("length,widths", [(400, (256, 32, 4, 1)), (100, (64, 8, 1)), (40, (16, 4, 1))])
def test_brute_force(spark, length, widths):
    compare(spark, passages(1), length, widths=widths)


def test_crowded_leads(spark, skewed):
    """Leads with many stretches are cut down to single strings."""
    compare(spark, passages(2), 100, widths=(64, 8, 1), crowd=2)
    compare(spark, passages(3), 400, crowd=1)


def test_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FEW", 0)
    compare(spark, passages(4), 100, widths=(64, 8, 1))


def test_pieces_of_a_long_text(spark):
    rng = random.Random(5)
    part = words(rng, 40_000, 10_000)
    assert len(part.encode()) > 3 * suffix_dedup.PIECE
    compare(spark, [part, "x" + part[70_001:], "é" * 70_000], 400)


def test_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert suffix_dedup.remove_repeated(empty).count() == 0
    docs = spark.createDataFrame([(None, "x" * 500, None, None, None), (None, None, None, None, None), (1, "y" * 399, "a", 1, "b")], DOCS)
    found = sorted((tuple(r) for r in suffix_dedup.remove_repeated(docs).collect()), key=repr)
    nothing = hashlib.sha256(b"").hexdigest()
    assert found == sorted([(None, 500, 500, 1, nothing), (None, 0, 0, 0, nothing), (1, 399, 0, 0, hashlib.sha256(b"y" * 399).hexdigest())], key=repr)


@pytest.mark.parametrize("bad", [(100, 1), (8, 4), (64, 1)])
def test_widths(spark, bad):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeated(spark.createDataFrame([], DOCS), length=70, widths=bad)


def test_multikey_order():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (800, 5)).astype(np.uint64) * np.uint64(1 << 20)
    order, common = suffix_dedup.multikey_order(words)
    rows = [w.astype(">u8").tobytes() for w in words[order]]
    assert rows == sorted(rows)
    for a, b, c in zip(rows, rows[1:], common[1:]):
        assert c == next((i for i in range(40) if a[i] != b[i]), 40)


def test_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_suffix_dedup"](spark, f"{DATA}/sf0.01").collect()}
    wanted = {d.doc_id: w[:4] for d, w in zip(docs, expected([(d.text or "").encode() for d in docs], 400))}
    assert found == wanted
    assert sum(w[1] for w in wanted.values()) > 0
