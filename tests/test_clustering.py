"""Hand-made cases, brute-force comparison, and the skew paths forced onto small data."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from densegrid import ApproxClustering, approx_dbscan, exact_dbscan, fill_labels
from densegrid.functions.geometry import coin
from densegrid.operators import halo
from densegrid.operators.balls import connecting_links, lowest_cluster, within
from densegrid.operators.components import connected_components, extend_components, is_star, large_star, local_forest, small_star
from densegrid.operators.grid import Grid, valid_points
from densegrid.operators.labels import dense_labels
from densegrid.operators.links import closest_between_cells
from densegrid.operators.neighbors import core_sites, neighbor_counts, to_points
from densegrid.runtime import hot_join, hot_keys, number_rows, stage, tiled_join
from densegrid.sources import points as points_source


def points_of(spark, x):
    x = np.asarray(x, dtype=float)
    x = x[:, None] if x.ndim == 1 else x
    names = [f"x{k}" for k in range(x.shape[1])]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    schema = "point_id bigint, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema), names, x


def mixed(seed: int, d: int, n: int = 160) -> np.ndarray:
    """A dense spot with a third of the points, a pile of copies, and a loose rest."""
    rng = np.random.default_rng(seed)
    spot = 0.02 * rng.normal(size=(n // 3, d)) + 0.3
    loose = rng.uniform(0, 1.2, size=(n // 2, d))
    copies = np.repeat(loose[:1], n // 8, axis=0)
    line = np.stack([np.linspace(0, 1.2, n // 4)] + [np.full(n // 4, 0.9)] * (d - 1), axis=1)
    return rng.permutation(np.concatenate([spot, loose, copies, line]))


def as_dict(df):
    return {r["point_id"]: (r["cluster_id"], r["core_flag"]) for r in df.collect()}


@pytest.mark.parametrize("d,eps", [(1, 0.03), (2, 0.1), (3, 0.2), (4, 0.3), (5, 0.4)])
def test_skewed_data_against_brute_force(skewed, d, eps):
    points, names, x = points_of(skewed, mixed(d, d))
    got = {r["point_id"]: (r["neighbors"], r["core_flag"]) for r in neighbor_counts(points, names, eps, 5).collect()}
    wanted = np.minimum(brute.counts(x, eps, "strict"), 5)
    assert got == {i: (c, int(c >= 5)) for i, c in enumerate(wanted)}
    assert as_dict(approx_dbscan(points, names, eps, 5)) == brute.approx(x, eps, 5)
    labels, core = brute.exact(x, eps, 5)
    assert as_dict(exact_dbscan(points, names, eps, 5)) == {
        i: (label, int(c)) for i, (label, c) in enumerate(zip(labels.tolist(), core.tolist()))
    }


@pytest.mark.parametrize("d,eps", [(1, 0.03), (2, 0.1), (3, 0.2), (5, 0.4)])
def test_closest_points_of_cells(skewed, d, eps):
    points, names, x = points_of(skewed, np.unique(mixed(7, d), axis=0))
    grid = Grid.fit(points, names, eps)
    points = points.withColumnRenamed("point_id", "uid")
    placed = stage(grid.attach_gid(points, "uid").select("gid", "uid", *names), "placed")
    gid, _ = brute.cells(x, eps)
    wanted = brute.closest(x, gid, np.ones(len(x), dtype=bool), eps)
    got = {(r["src"], r["dst"]): r["min_dist"] for r in closest_between_cells(placed, names, eps, eps).collect()}
    assert got == wanted
    settled = closest_between_cells(placed, names, eps * 1.2, eps, settle=eps)
    assert {(r["src"], r["dst"]) for r in settled.filter(f"min_dist <= {eps!r}").collect()} == set(wanted)


def test_rules_count_copies_differently(spark):
    points, names, _ = points_of(spark, [[1.0, 2.0]] * 6)
    assert approx_dbscan(points, names, 0.5, 5).count() == 0
    assert as_dict(exact_dbscan(points, names, 0.5, 5)) == {i: (0, 1) for i in range(6)}


def test_edge_across_a_partition_bound(spark):
    points, names, _ = points_of(spark, [0, 3.3, 3.4, 4.2, 5.1, 6.0, 6.05, 10])
    found = as_dict(approx_dbscan(points, names, 1.0, 3))
    assert found[3][0] == found[4][0]


@pytest.mark.parametrize("parts", [1, 2, 3, 5])
def test_flags_do_not_depend_on_the_partitions(spark, parts):
    points, names, x = points_of(spark, mixed(3, 2))
    grid = Grid.fit(points, names, 0.1)
    placed = grid.locate(points).select("*", F.expr(grid.gid(grid.cells)).alias("gid"))
    copies = halo.replicate(placed, grid, [parts] * 2)
    assert copies.filter("is_home = 1").count() == len(x)
    seen = core_sites(copies, names, 0.1, 5, scope=["paid"])
    flags = to_points(copies, grid.attach_gid(seen, "uid"), names, ["paid"])
    got = {r["point_id"]: r["core_flag"] for r in halo.merge_flags(flags).collect()}
    assert got == {i: int(c >= 5) for i, c in enumerate(brute.counts(x, 0.1, "strict"))}
    home = copies.filter("is_home = 1").select("paid", "point_id")
    at_home = {r["point_id"]: r["core_flag"] for r in flags.join(home, ["paid", "point_id"]).collect()}
    assert at_home == got


def test_constant_column_and_maximum(spark):
    points, names, _ = points_of(spark, [[float(i), 7.0] for i in range(11)])
    grid = Grid.fit(points, names, 1.5)
    assert grid.n[1] == 1 and grid.width[1] == 0
    last = grid.locate(points).filter("x0 = 10").first()
    assert last["c0"] == grid.n[0] - 1 and last["c1"] == 0


def test_range_below_one_cell(spark):
    points, names, _ = points_of(spark, [[0.0, 0.0], [0.1, 0.0], [0.0, 0.1]])
    grid = Grid.fit(points, names, 5.0)
    assert grid.n == (1, 1)
    assert approx_dbscan(points, names, 5.0, 2).count() == 3


def test_all_noise(spark):
    points, names, _ = points_of(spark, [[10.0 * i] for i in range(5)])
    labeled = fill_labels(points, approx_dbscan(points, names, 1.0, 2))
    assert [tuple(r) for r in labeled.select("cluster_id", "core_flag", "is_noise").distinct().collect()] == [(0, -1, 1)]
    assert all(c == -1 for c, _ in as_dict(exact_dbscan(points, names, 1.0, 2)).values())


def test_core_cells_without_edges(spark):
    points, names, _ = points_of(spark, [[0.0], [0.1], [0.2], [50.0], [50.1], [50.2]])
    found = as_dict(approx_dbscan(points, names, 1.0, 2))
    assert len(found) == 6 and len({c for c, _ in found.values()}) == 2


def test_tolerance_band(spark):
    eps, rho = 1.0, 0.1
    x = [[0.0], [0.3], [0.5], [1.55], [1.7], [2.0], [9.0]]
    points, names, _ = points_of(spark, x)
    edges = {
        p: {(r["src"], r["dst"]) for r in ApproxClustering(points, names, eps, 2, rho, p, seed=s).edges.collect()}
        for p, s in (("never", 0), ("always", 0), ("seeded", 1))
    }
    assert edges["never"] <= edges["seeded"] <= edges["always"]
    assert len(edges["always"]) == len(edges["never"]) + 1


def test_border_modes(spark):
    points, names, x = points_of(spark, mixed(5, 2))
    labels, core = brute.exact(x, 0.1, 5)
    found = as_dict(ApproxClustering(points, names, 0.1, 5, grid_kind="exact", rule="standard", border="eps").clusters())
    assert set(found) == set(np.flatnonzero(labels >= 0).tolist())
    assert {i for i, (_, c) in found.items() if c} == set(np.flatnonzero(core).tolist())


def test_cells_too_many_to_number(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(40, 12)) * 0.05, rng.uniform(0, 1000, size=(20, 12))])
    points, names, x = points_of(spark, x)
    job = ApproxClustering(points, names, 1.0, 5)
    assert not job.grid.fits
    assert sorted(as_dict(job.clusters())) == list(range(40))


def test_order_and_partitioning_do_not_matter(spark):
    points, names, _ = points_of(spark, mixed(9, 2))
    once = as_dict(approx_dbscan(points, names, 0.1, 5))
    assert as_dict(approx_dbscan(points.repartition(7).orderBy("x0"), names, 0.1, 5)) == once


def test_invalid_points(spark):
    rows = [(0, 1.0), (1, None), (2, float("nan")), (3, float("inf"))]
    points = spark.createDataFrame(rows, "point_id bigint, x0 double")
    assert [r["point_id"] for r in valid_points(points, ["x0"]).collect()] == [0]
    with pytest.raises(ValueError):
        Grid.fit(points, ["x0"], 1.0)


@pytest.mark.parametrize("parts", [1, 6])
def test_components(skewed, parts):
    rng = np.random.default_rng(parts)
    path = [(i, i + 1) for i in range(0, 120)]
    hub = [(200, 200 + i) for i in range(1, 80)]
    loose = [tuple(map(int, rng.integers(300, 380, size=2))) for _ in range(40)]
    pairs = [path[i] for i in rng.permutation(len(path))] + hub + loose
    n = 400
    vertices = skewed.range(n)
    edges = skewed.createDataFrame(pairs, "src bigint, dst bigint").repartition(parts)
    got = {r["id"]: r["component"] for r in connected_components(vertices, edges).collect()}
    wanted = brute.join_sets(n, pairs)
    assert got == {i: int(c) for i, c in enumerate(wanted)}


def test_star_rounds_alone(skewed):
    pairs = [(i, i + 1) for i in range(40)] + [(60, 60 + i) for i in range(1, 40)]
    stars = stage(skewed.createDataFrame(pairs, "src bigint, dst bigint"), "stars")
    for _ in range(20):
        if is_star(stars):
            break
        stars = stage(small_star(stage(large_star(stars), "stars")), "stars")
    got = {(r["src"], r["dst"]) for r in stars.collect()}
    assert got == {(0, i) for i in range(1, 41)} | {(60, 60 + i) for i in range(1, 40)}
    assert {(r["src"], r["dst"]) for r in local_forest(stars.coalesce(1)).collect()} == got


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_join(skewed, how):
    left = stage(skewed.createDataFrame([(i, 0 if i < 60 else i) for i in range(100)], "v long, k long"), "left")
    right = skewed.createDataFrame([(k, k * 10) for k in range(0, 90, 2)], "k long, w long")
    assert [r["k"] for r in hot_keys(left, ["k"]).collect()] == [0]
    assert sorted(map(str, hot_join(left, right, ["k"], how).collect())) == sorted(
        map(str, left.join(right, ["k"], how).collect())
    )


def test_numbering(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 AS k").repartition(5)
    numbered = {r["k"]: r["idx"] for r in number_rows(df, ["k"], "idx").collect()}
    assert numbered == {k: i for i, k in enumerate(sorted(numbered))}


def test_dense_labels_follow_first_appearance(spark):
    df = spark.createDataFrame([(0, 9), (1, -1), (2, 9), (3, 4), (4, -1)], "point_id long, c long")
    got = [r["c"] for r in dense_labels(df, "c").orderBy("point_id").collect()]
    assert got == [0, 1, 0, 2, 1]


# Input contract, ids and chunks


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_invalid_features_raise_or_are_dropped(spark, bad):
    rows = [(i, i / 10, 0.0) for i in range(8)] + [(8, 0.3, bad)]
    points = spark.createDataFrame(rows, "point_id bigint, `a.b` double, `c d` double")
    names = ["a.b", "c d"]
    calls = [
        lambda **o: neighbor_counts(points, names, 1.0, 3, **o), lambda **o: exact_dbscan(points, names, 1.0, 3, **o),
        lambda **o: approx_dbscan(points, names, 1.0, 3, **o),
    ]
    for call in calls:
        with pytest.raises(Exception, match="features must be finite; point 8"):
            call().collect()
        assert call(invalid="drop").count() == 8


def test_coin_takes_any_id(spark):
    ids = [(1, 2), (10**14, 2 * 10**14), (2**61, 2**61 + 5)]
    df = spark.createDataFrame(ids, "src bigint, dst bigint")
    found = df.select(coin(F.col("src"), F.col("dst"), 11)).collect()
    assert [r[0] for r in found] == [(s * 7919 + d * 104729 + 11) % 1000003 % 2 == 1 for s, d in ids]


def test_components_in_small_chunks(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20] + [(5, 45)], "src bigint, dst bigint")
    vertices = spark.range(61)
    found = {r["id"]: r["component"] for r in connected_components(vertices, edges, chunk=7).collect()}
    assert found == {r["id"]: r["component"] for r in connected_components(vertices, edges).collect()}
    assert found[45] == found[5] and found[0] == 0


def test_tiled_join_is_the_join(skewed):
    left = skewed.createDataFrame([(i % 3, i) for i in range(200)], "k int, a int")
    right = skewed.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(150)], "k int, b int")
    wanted = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, tiled_join(left, right, ["k"]).collect())) == wanted


def test_whole_vectors_only(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, v array<double>").write.parquet(str(tmp_path / "v"))
    assert points_source.from_array(spark, str(tmp_path / "v"), "id", "v", 2).first()["x1"] == 2.0
    with pytest.raises(Exception, match="should have 3 elements, not 2"):
        points_source.from_array(spark, str(tmp_path / "v"), "id", "v", 3).collect()


def test_components_grow_by_contraction(spark, skewed):
    """New edges are added to the known labels; the result is that of a run on all edges, and only new ones are solved."""
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)]
    vertices = spark.range(300)

    def table(rows):
        return spark.createDataFrame(rows, "src long, dst long")

    known = stage(connected_components(vertices, table(edges[:120])), "known")
    for part in (edges[120:180], edges[180:], edges[:10], []):
        known = stage(extend_components(known, table(part)), "known")
    whole = connected_components(vertices, table(edges))
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("rule", ["strict", "standard"])
def test_balls_count_what_all_pairs_count(skewed, rule):
    """Many dimensions, copies and hot balls: counts equal brute force, and most pairs are never looked at."""
    rng = np.random.default_rng(9)
    centers = rng.normal(0, 4, size=(12, 8))
    x = centers[rng.integers(0, 12, 500)] + rng.normal(0, 0.3, size=(500, 8))
    x[:40] = x[0]
    x[450:] = rng.uniform(-20, 20, size=(50, 8))
    names = [f"x{k}" for k in range(8)]
    points = skewed.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "point_id bigint, " + ", ".join(f"{n} double" for n in names))
    report = {}
    found = {r["point_id"]: r["neighbors"] for r in neighbor_counts(points, names, 0.8, 5, rule=rule, report=report).collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    equal = (x[:, None] == x[None]).all(axis=2)
    near = (far <= 0.8) & (~equal if rule == "strict" else True)
    assert found == {i: min(5, int(n)) for i, n in enumerate(near.sum(axis=1))}
    assert report["pairs"] < 0.15 * report["sites"] ** 2


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_within_is_the_distance_of_columns(offset):
    """Distances that equal the radius, and data far from the origin, are decided as squares summed in order."""
    rng = np.random.default_rng(4)
    x = offset + rng.integers(0, 4, size=(200, 9)) * 0.1
    total = np.zeros((200, 200))
    for k in range(9):
        total += (x[:, None, k] - x[None, :, k]) ** 2
    for radius in (0.3, 0.5, float(np.sqrt(total[0, 1]))):
        assert np.array_equal(within(x, x, radius), np.sqrt(total) <= radius)


def test_links_in_many_dimensions_connect_without_listing_all(spark):
    """Where every point has many neighbours, few links are made, and they connect what all pairs connect."""
    rng = np.random.default_rng(12)
    centers = rng.normal(0, 5, size=(6, 8))
    x = centers[rng.integers(0, 6, 400)] + rng.normal(0, 0.4, size=(400, 8))
    x[:30] = rng.uniform(-15, 15, size=(30, 8))
    points, names, x = points_of(spark, x)
    eps = 1.6
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    placed = stage(points.select(F.col("point_id").alias("uid"), (F.col("point_id") * 7).alias("gid"), *names), "placed")
    links = connecting_links(placed, names, eps).collect()
    assert all(near[r["src"] // 7, r["dst"] // 7] for r in links)
    assert len(links) < 2 * len(x) < near.sum() // 4

    def roots(pairs):
        root = list(range(len(x)))
        for _ in range(len(x)):
            before = list(root)
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
            if root == before:
                return root

    assert roots([(r["src"] // 7, r["dst"] // 7) for r in links]) == roots(np.argwhere(near).tolist())

    owners = stage(placed.filter("uid % 3 = 0").select("uid", (F.col("uid") % 11).alias("cluster_id"), *names), "owners")
    found = {r["uid"]: r["cluster_id"] for r in lowest_cluster(placed, owners, names, eps).collect()}
    assert found == {i: min(c) for i in range(len(x)) if (c := [j % 11 for j in range(0, len(x), 3) if near[i, j]])}
    assert connecting_links(placed.filter("uid < 0"), names, eps).count() == 0


def test_copies_with_many_features(spark):
    """Points of an array with copies: the join of copies by all features is planned in moderate time and memory."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 64))
    x[40:] = x[:20]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    names = [f"x{k}" for k in range(64)]
    points = rows.select(F.col("id").alias("point_id"), *[F.col("v")[k].cast("double").alias(n) for k, n in enumerate(names)])
    found = {r["point_id"]: r["neighbors"] for r in neighbor_counts(points, names, 10.0, 5, stable=True).collect()}
    assert found == {i: min(5, int(c)) for i, c in enumerate(brute.counts(x, 10.0, "strict"))}
