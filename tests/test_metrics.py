"""Agreement and silhouette against direct formulas."""

import decimal
import math

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from densegrid.functions.special import ln_factorial
from densegrid.operators import metrics, silhouette as sil
from densegrid.plans.evaluate import compare_labels, evaluate
from densegrid.runtime import stage


def table_of(spark, x, labels):
    x = np.asarray(x, dtype=float)
    names = [f"x{k}" for k in range(x.shape[1])]
    rows = [(i, int(label), *map(float, r)) for i, (label, r) in enumerate(zip(labels, x))]
    schema = "point_id bigint, label bigint, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema), names


def direct_silhouette(x, labels):
    far = brute.distances(np.asarray(x, dtype=float))
    labels = np.asarray(labels)
    scores = []
    for i, label in enumerate(labels):
        mine = labels == label
        if mine.sum() == 1:
            scores.append(0.0)
            continue
        a = far[i, mine].sum() / (mine.sum() - 1)
        b = min(far[i, labels == o].mean() for o in set(labels.tolist()) - {label})
        scores.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return float(np.mean(scores))


def groups(seed, d, k, n=240):
    rng = np.random.default_rng(seed)
    centers = rng.uniform(0, 10, size=(k, d))
    labels = rng.integers(0, k, size=n)
    x = centers[labels] + rng.normal(size=(n, d)) * rng.uniform(0.1, 1.5, size=(k, 1))[labels]
    x[: n // 4] = x[0]
    labels[: n // 4] = labels[0]
    return x, labels


@pytest.mark.parametrize("d,k", [(1, 3), (2, 40), (3, 8)])
def test_silhouette_is_exact_on_small_data(spark, monkeypatch, d, k):
    monkeypatch.setattr(sil, "BOX_ROWS", 40)
    x, labels = groups(d, d, k)
    df, names = table_of(spark, x, labels)
    assert sil.silhouette(df, names, "label").first()[0] == pytest.approx(direct_silhouette(x, labels), abs=1e-9)


def test_silhouette_in_tiles(spark, monkeypatch):
    """The exact mode with several tiles per label and several groups of boxes."""
    for name, rows in (("BOX_ROWS", 20), ("TILE_ROWS", 15), ("TILE_BOXES", 2)):
        monkeypatch.setattr(sil, name, rows)
    x, labels = groups(5, 2, 4)
    df, names = table_of(spark, x, labels)
    wanted = direct_silhouette(x, labels)
    assert sil.silhouette(df, names, "label").first()[0] == pytest.approx(wanted, abs=1e-9)
    named = df.withColumn("label", F.concat(F.lit("label "), F.col("label").cast("string")))
    assert sil.silhouette(named, names, "label").first()[0] == pytest.approx(wanted, abs=1e-9)


@pytest.mark.parametrize("d,k", [(2, 3), (3, 12)])
def test_silhouette_with_grouped_sources(skewed, monkeypatch, d, k):
    monkeypatch.setattr(sil, "BOX_ROWS", 60)
    monkeypatch.setattr(sil, "NEAR_ROWS", 10)
    monkeypatch.setattr(sil, "FEW_ROWS", 2)
    x, labels = groups(d, d, k)
    df, names = table_of(skewed, x, labels)
    wanted = direct_silhouette(x, labels)
    found = sil.silhouette(df, names, "label", theta=0.2).first()
    assert found["silhouette"] == pytest.approx(wanted, abs=2e-3)
    assert found["mode"] == "grouped" and abs(found["silhouette"] - wanted) <= found["error_bound"] < 0.02


def test_tiles_travel_where_they_are_wanted(spark, monkeypatch):
    """Sources shuffle once per group of boxes that asks for their label, and not to all groups."""
    for name, rows in (("BOX_ROWS", 10), ("TILE_ROWS", 15), ("TILE_BOXES", 2)):
        monkeypatch.setattr(sil, name, rows)
    moved = {}

    def routed(sites, pairs, space):
        wanted, sources = original(sites, pairs, space)
        per_tile = sources.groupBy("other", "tile").agg(F.countDistinct("group").alias("groups"), F.count("*").alias("n"))
        asked = wanted.groupBy("other", "tile").agg(F.countDistinct("group").alias("asked"))
        moved["tiles"] = per_tile.join(asked, ["other", "tile"], "full").collect()
        moved["groups"], moved["sites"] = wanted.select("group").distinct().count(), sites.count()
        moved["rows"] = sources.count()
        return wanted, sources

    original = sil._routed
    monkeypatch.setattr(sil, "_routed", routed)
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 12, size=600)
    x = np.stack([labels * 100.0, labels % 3 * 50.0], axis=1) + rng.normal(size=(600, 2))
    df, names = table_of(spark, x, labels)
    assert sil.silhouette(df, names, "label").first()[0] == pytest.approx(direct_silhouette(x, labels), abs=1e-9)
    assert all(r["groups"] == r["asked"] for r in moved["tiles"])
    assert moved["rows"] < 0.5 * moved["groups"] * moved["sites"]


def test_distances_of_a_tile_are_arrays(spark, monkeypatch):
    """Points and a tile meet as arrays: what leaves is a row per point and tile, not per pair."""
    rng = np.random.default_rng(8)
    x, y, w = rng.normal(size=(300, 3)), rng.normal(size=(2500, 3)), rng.integers(1, 4, 2500).astype(float)
    left = pa.table({"uid": range(300), "label": [0] * 300, "mult": [1] * 300, "other": [1] * 300, "n_label": [9] * 300, "x": x.tolist()})
    far = sil._distances(3)(left, pa.table({"x": y.tolist(), "w": w}))
    wanted = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)) @ w
    assert far.num_rows == 300 and np.allclose(far.column("far").to_numpy(), wanted, rtol=1e-13)


def test_grouped_silhouette_far_from_the_middle(spark, monkeypatch):
    """Small groups far out: their covariance comes from their own corner, so it does not cancel away."""
    monkeypatch.setattr(sil, "NEAR_ROWS", 10)
    monkeypatch.setattr(sil, "FEW_ROWS", 2)
    rng = np.random.default_rng(6)
    labels = np.repeat([0, 1, 2, 3], 60)
    x = np.array([[3000, 0], [3003, 1], [-3000, 5], [-3000, 9]])[labels] + rng.normal(size=(240, 2)) * 0.4
    df, names = table_of(spark, x, labels)
    found = sil.silhouette(df, names, "label", theta=0.3).first()
    assert abs(found["silhouette"] - direct_silhouette(x, labels)) < 1e-3


def test_silhouette_edge_cases(spark):
    df, names = table_of(spark, [[0.0], [1.0], [2.0]], [4, 4, 4])
    assert sil.silhouette(df, names, "label").first()[0] is None
    df, names = table_of(spark, [[0.0], [1.0], [5.0]], [0, 0, 1])
    assert sil.silhouette(df, names, "label").first()[0] == pytest.approx(direct_silhouette([[0.0], [1.0], [5.0]], [0, 0, 1]))


def direct_ari_ami(u, v):
    u, v = np.asarray(u), np.asarray(v)
    n = len(u)
    table = np.array([[np.sum((u == a) & (v == b)) for b in sorted(set(v))] for a in sorted(set(u))])
    a, b = table.sum(axis=1), table.sum(axis=0)
    pairs = lambda c: sum(math.comb(int(i), 2) for i in np.ravel(c))
    expected = pairs(a) * pairs(b) / math.comb(n, 2)
    ari = (pairs(table) - expected) / ((pairs(a) + pairs(b)) / 2 - expected)
    h = lambda c: -sum(i / n * math.log(i / n) for i in c)
    mi = sum(table[i, j] / n * math.log(n * table[i, j] / (a[i] * b[j]))
             for i in range(len(a)) for j in range(len(b)) if table[i, j])
    emi = 0.0
    for i in map(int, a):
        for j in map(int, b):
            for k in range(max(1, i + j - n), min(i, j) + 1):
                weight = math.comb(i, k) * math.comb(n - i, j - k) / math.comb(n, j)
                emi += k / n * math.log(n * k / (i * j)) * weight
    return ari, (mi - emi) / ((h(a) + h(b)) / 2 - emi)


def test_agreement(spark):
    rng = np.random.default_rng(4)
    u = rng.integers(0, 6, size=300)
    v = np.where(rng.uniform(size=300) < 0.7, u // 2, rng.integers(0, 9, size=300))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(u, v)], "a long, b long")
    table = stage(metrics.contingency(df, "a", "b"), "table")
    ari, ami = direct_ari_ami(u, v)
    assert metrics.ari(table).first()[0] == pytest.approx(ari, abs=1e-9)
    assert metrics.ami(table).first()[0] == pytest.approx(ami, abs=1e-9)


def precise_information(a, b, n, reach):
    """Expected mutual information of two labels per side, in 50 digits; weights by their ratios, scaled to 1."""
    with decimal.localcontext() as context:
        context.prec = 50
        middle = a * b // n
        low, high = max(0, a + b - n, middle - reach), min(a, b, middle + reach)
        weights = {middle: decimal.Decimal(1)}
        for k in range(middle, high):
            weights[k + 1] = weights[k] * (a - k) * (b - k) / ((k + 1) * (n - a - b + k + 1))
        for k in range(middle, low, -1):
            weights[k - 1] = weights[k] * k * (n - a - b + k) / ((a - k + 1) * (b - k + 1))
        whole, found = sum(weights.values()), decimal.Decimal(0)
        for k, weight in weights.items():
            for x, p, q in ((k, a, b), (a - k, a, n - b), (b - k, n - a, b), (n - a - b + k, n - a, n - b)):
                if x:
                    found += weight * x / n * (decimal.Decimal(x) * n / (p * q)).ln()
        return float(found / whole)


@pytest.mark.parametrize("a,b,n,reach", [
    (10**6, 10**6, 10**12, 80), (10**8, 10**8, 10**12, 1500), (3, 10**11, 10**12, 10), (10**5, 2 * 10**7, 10**12, 60), (40, 60, 100, 100), (5, 5, 10, 10),
])
def test_expected_information_of_large_tables(spark, a, b, n, reach):
    rows = [(0, 0, 1), (0, 1, a - 1), (1, 0, b - 1), (1, 1, n - a - b + 1)]
    table = spark.createDataFrame(rows, "label_true long, label_pred long, n long")
    found = metrics.expected_information(table, n).first()[0]
    assert found == pytest.approx(precise_information(a, b, n, reach), rel=1e-9)


@pytest.mark.parametrize("labels", [[0, 0, 1, 1, 2], [7, 7, 7, 7, 7]])
def test_identical_labelings(spark, labels):
    df = spark.createDataFrame([(v, v + 10) for v in labels], "a long, b long")
    table = stage(metrics.contingency(df, "a", "b"), "table")
    assert metrics.ari(table).first()[0] == 1.0
    assert metrics.ami(table).first()[0] == pytest.approx(1.0)


def test_evaluate_is_one_row(spark):
    x, labels = groups(1, 2, 4, n=60)
    df, names = table_of(spark, x, labels)
    found = evaluate(df, names, "label", "label").collect()
    assert len(found) == 1
    assert (found[0]["ari"], round(found[0]["ami"], 9)) == (1.0, 1.0)
    assert found[0]["silhouette"] == pytest.approx(direct_silhouette(x, labels))


def test_ln_factorial(spark):
    rows = spark.range(0, 400).select("id", ln_factorial(F.col("id")).alias("v")).collect()
    for r in rows:
        assert r["v"] == pytest.approx(math.lgamma(r["id"] + 1), rel=1e-13, abs=1e-13)


def test_compared_points_are_checked_once(spark):
    """Missing features are left out of both runs, and names need not be identifiers."""
    names = ["a b", "c.d"]
    rows = [(i, float(i % 7), float(i // 7)) for i in range(49)] + [(100, None, 1.0), (101, float("nan"), 1.0)]
    points = spark.createDataFrame(rows, "point_id bigint, `a b` double, `c.d` double")
    compared = compare_labels(points, names, 1.1, 3, invalid="drop")
    assert compared.columns == ["point_id", *names, "cluster_id", "is_noise", "exact_cluster"]
    assert sorted(r["point_id"] for r in compared.collect()) == list(range(49))
    assert evaluate(compared, names, "cluster_id", "exact_cluster").count() == 1
