"""Centroids and vector codes against brute force in Python integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from densegrid.llm import centroids, vector_codes
from densegrid.llm.whole import Whole, least_by_row, squares

VECTORS = "vec_id long, embedding array<double>, label int, cluster int, v string, error long"


def floors(row, scale=256):
    return [math.floor(Fraction(float(x)) * scale) for x in row]


def nearest(row, books):
    distances = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in books]
    return distances.index(min(distances)), min(distances)


def means(rows, chosen, books):
    out = []
    for c, old in enumerate(books):
        mine = [r for r, k in zip(rows, chosen) if k == c]
        out.append([sum(x) // len(mine) for x in zip(*mine)] if mine else old)
    return out


def brute_clusters(rows, k, rounds):
    kept = [(i, floors(v)) for i, v in rows]
    books = [v for _, _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), i, v) for i, v in kept if i is not None)[:k]]
    for _ in range(rounds):
        books = means([v for _, v in kept], [nearest(v, books)[0] for _, v in kept], books)
    told = [(i, *nearest(v, books)) for i, v in kept]
    inertia = sum(d for _, _, d in told)

    def fits(x):
        return x if x < 1 << 63 else None

    def total(chosen):
        return None if any(fits(d) is None for d in chosen) else fits(sum(chosen))

    every = total([d for _, _, d in told])
    return [
        (i, c, fits(d), total([e for _, b, e in told if b == c]), every, hashlib.sha256(",".join(map(str, books[c])).encode()).hexdigest())
        for i, c, d in told
    ] if inertia is not None else []


def brute_codes(rows, parts, k, rounds):
    """``rows`` are (vec_id, label, vector)."""
    kept = [(i, label, floors(v)) for i, label, v in rows]
    width = len(kept[0][2]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:k]
    cut = [[v[p * width: (p + 1) * width] for _, _, v in kept] for p in range(parts)]
    books = [[v[p * width: (p + 1) * width] for _, _, v in first] for p in range(parts)]
    for _ in range(rounds):
        books = [means(cut[p], [nearest(x, books[p])[0] for x in cut[p]], books[p]) for p in range(parts)]
    told = []
    for r, (i, label, _) in enumerate(kept):
        best = [nearest(cut[p][r], books[p]) for p in range(parts)]
        told.append((i, label, "".join(f"{c:02x}" for c, _ in best), sum(d for _, d in best)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()

    def total(label):
        found = [e for _, other, _, e in told if other == label]
        return None if max(found) >= 1 << 63 or sum(found) >= 1 << 63 else sum(found)

    return [(i, code, e if e < 1 << 63 else None, total(label), digest) for i, label, code, e in told]


def sample(n, d, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 0.3, (12, d))
    x = centers[rng.integers(0, 12, n)] + rng.normal(0, 0.05, (n, d))
    x[::7] = x[0]
    x[1::9] = np.round(x[1::9], 1)
    return x


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if y is None else float(y) for y in v], label, 7, "v", 1) for i, v, label in rows], VECTORS)


def invalid(d):
    return [(901, None, 1), (902, [None] * d, 1), (903, [float("nan")] + [0.0] * (d - 1), 1), (904, [float("inf")] * d, 1), (905, [0.5] * (d - 1), 1), (906, [], 1)]


def same(found, wanted):
    assert sorted((tuple(r) for r in found), key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("n,k", [(400, 9), (5, 9), (60, 40)])
def test_clusters(spark, n, k):
    x = sample(n, 64, n)
    rows = [(i, v) for i, v in enumerate(x)] + [(None, x[3])]
    docs = frame(spark, [(i, v, 1) for i, v in rows] + invalid(64)).repartition(3)
    same(centroids.cluster(docs, k=k).collect(), brute_clusters(rows, k, 5))


def test_clusters_of_equal_vectors(spark):
    rows = [(i, [0.25] * 64) for i in range(20)]
    same(centroids.cluster(frame(spark, [(i, v, 1) for i, v in rows]), k=4).collect(), brute_clusters(rows, 4, 5))


@pytest.mark.parametrize("large", [1e6, 1e12, 1e40, 1e308])
def test_clusters_of_large_numbers(spark, large):
    x = sample(40, 64, 2)
    x[3], x[4, 5], x[5] = x[3] * large, -large, x[3] * large * 0.5
    rows = list(enumerate(x))
    same(centroids.cluster(frame(spark, [(i, v, 1) for i, v in rows]), k=6).collect(), brute_clusters(rows, 6, 5))


def test_cluster_filter_leaves_centroids_out():
    x = Whole(sample(2000, 64, 3), 256)
    books = x.rows()[:40]
    simplex, whole = centroids.Simplex(books), centroids._whole(books)
    found, distance, compared = centroids.nearest(x, simplex.apexes(x), whole, simplex.apexes(whole))
    assert compared < 0.5 * 2000 * 40
    assert [(int(c), int(d)) for c, d in zip(found, distance)] == [nearest(r, books) for r in x.rows()]


@pytest.mark.parametrize("n,k", [(300, 20), (7, 20)])
def test_codes(spark, n, k):
    x = sample(n, 16, n)
    rows = [(i, None if i % 5 == 0 else i % 3, v) for i, v in enumerate(x)] + [(None, 1, x[2]), (3, 1, x[3])]
    docs = frame(spark, [(i, v, label) for i, label, v in rows] + invalid(16)).repartition(3)
    same(vector_codes.encode(docs, d=16, parts=4, k=k).collect(), brute_codes(rows, 4, k, 2))


@pytest.mark.parametrize("large", [1e6, 1e12, 1e40, 1e308])
def test_codes_of_large_numbers(spark, large):
    x = sample(60, 16, 4)
    x[3], x[40, 5], x[41] = x[3] * large, -large, x[3] * large * 0.5
    rows = [(i, i % 2, v) for i, v in enumerate(x)]
    same(vector_codes.encode(frame(spark, [(i, v, label) for i, label, v in rows]), d=16, parts=4, k=8).collect(), brute_codes(rows, 4, 8, 2))


def test_codes_with_many_labels(spark, skewed, monkeypatch):
    monkeypatch.setattr(vector_codes, "FEW", 0)
    rows = [(i, None if i % 3 else i, v) for i, v in enumerate(sample(100, 16, 6))]
    same(vector_codes.encode(frame(spark, [(i, v, label) for i, label, v in rows]), d=16, parts=4, k=8).collect(), brute_codes(rows, 4, 8, 2))


def test_trees_take_groups_as_a_whole():
    x = np.repeat(sample(100, 16, 7), 40, axis=0) + np.random.default_rng(8).normal(0, 0.002, (4000, 16))
    points, group = vector_codes._parts(x, 4, 256)
    forest = vector_codes.Forest.build(points.near, np.bincount(group))
    for node in range(0, len(forest.begin), 23):
        rows = forest.order[forest.begin[node]: forest.end[node]]
        far = np.sqrt(((points.near[rows] - points.near[forest.center[node]]) ** 2).sum(axis=1)).max()
        assert abs(far - forest.radius[node]) < 1e-9
    books = [row for p in range(4) for row in points.small[group == p][:2000:100].tolist()]
    sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(points.small[forest.order], axis=0)])
    entry, best, size, total, compared = vector_codes.assign(points, sums, forest, group, centroids._whole(books), 20)
    gaps = ((points.small[:, None, :] - np.array(books).reshape(4, 20, 4)[group]) ** 2).sum(axis=2)
    assert (entry == gaps.argmin(axis=1) + group * 20).all()
    assert size.sum() == len(points) and compared < 0.3 * 20 * len(points)
    assert (size > 1).sum() > 50


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert centroids.cluster(empty).count() == 0 and vector_codes.encode(empty).count() == 0
    only_invalid = frame(spark, invalid(64))
    assert centroids.cluster(only_invalid).count() == 0 and vector_codes.encode(only_invalid).count() == 0


def test_exact_squares():
    a = Whole(np.array([[1.5, -1e300], [0.25, -0.001], [3.0, 4.0]]), 256)
    assert a.rows()[1:] == [[64, -1], [768, 1024]]
    i, j = np.array([0, 0, 1, 2]), np.array([0, 1, 1, 2])
    found = squares(a, i, a, j)
    assert found[0] == found[2] == found[3] == 0 and found[1] == (384 - 64) ** 2 + (a.row(0)[1] + 1) ** 2
    assert least_by_row(np.array([0, 0, 1]), np.array([2, 5, 3]), np.array([7, 7, 1]), 2)[0].tolist() == [2, 3]
