"""Registered queries: one per operator, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densegrid.operators import halo, labels, metrics, neighbors
from densegrid.operators import silhouette as silhouettes
from densegrid.operators.grid import bin_edges, bounds, cell_box
from densegrid.operators.links import closest_between_cells
from densegrid.operators.sets import combine_sets, list_members, member_sets, set_sizes
from densegrid.plans.approx import ApproxClustering
from densegrid.plans.evaluate import compare_labels, evaluate
from densegrid.plans.exact import exact_dbscan
from densegrid.plans.input import halo as halo_points_of
from densegrid.plans.input import locate
from densegrid.runtime import HOT_ROWS, LEAF_PAIRS, stage
from densegrid.sources import blobs as blob_source
from densegrid.sources import points as source

MIN_PTS = 5
EPS = {"emb3": 0.06, "emb4": 0.12, "emb64": 1.2, "part2": 1.5, "cust1": 8.0, "supp2": 2.0, "user2": 2.0, "order2": 1.0}
RHO = 0.05
SEED = 11
PARTS = 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def point_set(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, list[str]]:
    d = int(name.lstrip("abcdefghijklmnopqrstuvwxyz"))
    points = source.emb(spark, sf_dir, d) if name.startswith("emb") else getattr(source, name)(spark, sf_dir)
    return points, source.feature_names(d)


#: Point sets that are columns of a table. The others are computed, and so staged before they are read several times.
PLAIN = ("emb64", "part2", "cust1", "supp2")


def run(spark: SparkSession, sf_dir: str, name: str = "emb3", **options) -> ApproxClustering:
    points, features = point_set(spark, sf_dir, name)
    return ApproxClustering(points, features, EPS[name], MIN_PTS, stable=name in PLAIN, **options)


# Sources and grid


@query
def points_load(spark, sf_dir):
    return source.emb(spark, sf_dir, 3)


@query
def points_index(spark, sf_dir):
    points = source.cust1(spark, sf_dir)
    return source.index(points, ["x0", "point_id"]).select("point_id", "idx")


@query
def blobs(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("point_id"))
    labeled = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), F.col("label").alias("center"))
    centers = source.emb(spark, sf_dir, 3).join(labeled, "point_id").groupBy("center").agg(
        *[(F.round(F.avg(f"x{k}"), 6) * 100.0).alias(f"m{k}") for k in range(3)]
    )
    made = blob_source.blobs(parts, centers, 3)
    return made.select("point_id", "center", *[F.round(f"x{k}", 6).alias(f"x{k}") for k in range(3)])


@query
def data_bounds(spark, sf_dir):
    points, features = point_set(spark, sf_dir, "emb3")
    return bounds(points, features)


@query
def grid_dims(spark, sf_dir):
    return run(spark, sf_dir, "part2").grid.table(spark)


@query
def bin_bounds(spark, sf_dir):
    return bin_edges(run(spark, sf_dir, "part2").grid.table(spark))


@query
def cell_assign(spark, sf_dir):
    job = run(spark, sf_dir)
    return job.grid.locate(job.points).select("point_id", *job.grid.cells)


@query
def cell_gid(spark, sf_dir):
    job = run(spark, sf_dir)
    return job.grid.attach_gid(job.points, "point_id").select("point_id", "gid")


def _occupied(job: ApproxClustering) -> DataFrame:
    return job.grid.attach_gid(job.points, "point_id").select("gid").distinct()


@query
def gid_to_cell(spark, sf_dir):
    job = run(spark, sf_dir)
    cells = job.grid.unlinear(F.col("gid"))
    return _occupied(job).select("gid", *[c.alias(n) for c, n in zip(cells, job.grid.cells)])


@query
def cell_bounds(spark, sf_dir):
    job = run(spark, sf_dir, "part2")
    cells = job.grid.unlinear(F.col("gid"))
    placed = _occupied(job).select("gid", *[c.alias(n) for c, n in zip(cells, job.grid.cells)])
    return cell_box(placed, job.grid).drop(*job.grid.cells)


@query
def cell_members(spark, sf_dir):
    job = run(spark, sf_dir, "part2")
    return job.grid.attach_gid(job.points, "point_id").groupBy("gid").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("point_id").alias("first_point"),
        F.max("point_id").alias("last_point"),
        F.sum(F.col("point_id").cast("decimal(38,0)")).alias("sum_points"),
    )


@query
def cell_member_sets(spark, sf_dir):
    job = run(spark, sf_dir, "part2")
    return member_sets(job.grid.attach_gid(job.points, "point_id"), ["gid"], "point_id")


@query
def point_lookup(spark, sf_dir):
    points, features = point_set(spark, sf_dir, "part2")
    return labels.lookup(points, points, features).select("point_id", "found_id")


# Neighbours and core points


@query
def neighbor_counts(spark, sf_dir):
    points, features = point_set(spark, sf_dir, "part2")
    return neighbors.neighbor_counts(points, features, EPS["part2"], MIN_PTS, stable=True)


@query
def neighbor_counts_emb64(spark, sf_dir):
    points, features = point_set(spark, sf_dir, "emb64")
    return neighbors.neighbor_counts(points, features, EPS["emb64"], MIN_PTS, stable=True)


@query
def core_points(spark, sf_dir):
    return run(spark, sf_dir).flags


@query
def core_points_standard(spark, sf_dir):
    return run(spark, sf_dir, "part2", rule="standard").flags


@query
def core_border_split(spark, sf_dir):
    flags = run(spark, sf_dir, "part2").flags
    core = flags.filter("core_flag = 1").withColumn("kind", F.lit("core"))
    border = flags.filter("core_flag = 0").withColumn("kind", F.lit("border"))
    return core.unionByName(border).groupBy("gid", "kind").agg(F.count(F.lit(1)).alias("n_points"))


@query
def core_cells(spark, sf_dir):
    return run(spark, sf_dir).core_cells


@query
def core_cell_counts(spark, sf_dir):
    flags = run(spark, sf_dir, "part2").flags
    return flags.groupBy("gid").agg(F.sum("core_flag").alias("n_core")).filter("n_core > 0")


@query
def core_cell_points(spark, sf_dir):
    job = run(spark, sf_dir)
    inside = neighbors.to_points(job.points, job.core_cell_sites, job.features, base=job.sites)
    return inside.select("gid", "point_id", "core_flag")


# Neighbour cells and components


@query
def eps_pairs(spark, sf_dir):
    job = run(spark, sf_dir, "part2")
    places = job.sites.select("gid", "uid", *job.features)
    return closest_between_cells(places, job.features, job.eps, job.eps)


@query
def cell_min_dist(spark, sf_dir):
    job = run(spark, sf_dir)
    return closest_between_cells(job.linked_points, job.features, job.eps * (1 + RHO), job.eps)


@query
def neighbor_cells_exact(spark, sf_dir):
    return run(spark, sf_dir).edges


@query
def neighbor_cells_always(spark, sf_dir):
    return run(spark, sf_dir, rho=RHO, rho_policy="always").edges


@query
def neighbor_cells_seeded(spark, sf_dir):
    return run(spark, sf_dir, rho=RHO, rho_policy="seeded", seed=SEED).edges


@query
def neighbor_cells_all_points(spark, sf_dir):
    return run(spark, sf_dir, cell_points="all").edges


@query
def cell_graph(spark, sf_dir):
    job = run(spark, sf_dir)
    vertices = job.core_cells.select(F.lit("vertex").alias("kind"), F.col("gid").alias("src"), F.col("gid").alias("dst"))
    return vertices.unionByName(job.edges.withColumn("kind", F.lit("edge")))


@query
def components(spark, sf_dir):
    return run(spark, sf_dir).components


# Clusters and labels


@query
def clusters(spark, sf_dir):
    return run(spark, sf_dir).clusters()


def _clusters_of(name: str, label: str, **options) -> None:
    def job(spark, sf_dir):
        return run(spark, sf_dir, name, **options).clusters()

    job.__name__ = label
    query(job)


_clusters_of("emb4", "clusters_emb4")
_clusters_of("emb64", "clusters_emb64")
_clusters_of("part2", "clusters_part2")
_clusters_of("cust1", "clusters_cust1")
_clusters_of("supp2", "clusters_supp2")
_clusters_of("emb3", "clusters_exact_grid", grid_kind="exact")
_clusters_of("part2", "clusters_standard", rule="standard", border="eps")
_clusters_of("emb3", "clusters_always", rho=RHO, rho_policy="always")
_clusters_of("emb3", "clusters_seeded", rho=RHO, rho_policy="seeded", seed=SEED)


@query
def clusters_user2(spark, sf_dir):
    return run(spark, sf_dir, "user2").clusters()


@query
def clusters_valid(spark, sf_dir):
    """Points with a missing feature are left out."""
    return run(spark, sf_dir, "order2", invalid="drop").clusters()


@query
def clusters_skew(spark, sf_dir):
    """The paths for uneven keys, with thresholds that the table passes."""
    before = {name: spark.conf.get(name, None) for name in (HOT_ROWS, LEAF_PAIRS)}
    spark.conf.set(HOT_ROWS, "200")
    spark.conf.set(LEAF_PAIRS, "50")
    try:
        return stage(run(spark, sf_dir, "part2").clusters(), "skew")
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@query
def cluster_members(spark, sf_dir):
    return labels.members(run(spark, sf_dir, "part2").clusters())


@query
def cluster_member_sets(spark, sf_dir):
    return member_sets(run(spark, sf_dir, "part2").clusters(), ["cluster_id"], "point_id")


@query
def cluster_border_points(spark, sf_dir):
    """The points of a cluster that are no core points, as a difference of sets."""
    found = stage(run(spark, sf_dir, "part2").clusters(), "clusters")
    every, core = (member_sets(df, ["cluster_id"], "point_id") for df in (found, found.filter("core_flag = 1")))
    return list_members(combine_sets(every, core, ["cluster_id"], "minus"), ["cluster_id"], "point_id")


@query
def border_eps(spark, sf_dir):
    job = run(spark, sf_dir)
    found = neighbors.to_points(job.points, job.border_assigned, job.features, base=job.sites)
    rest = job.flags.filter("core_flag = 0").select("point_id")
    return rest.join(found.select("point_id", "cluster_id"), "point_id", "left").select(
        "point_id", F.coalesce("cluster_id", F.lit(-1).cast("bigint")).alias("cluster_id")
    )


@query
def labels_filled(spark, sf_dir):
    job = run(spark, sf_dir, "part2")
    return labels.fill_labels(job.points, job.clusters())


@query
def distinct_counts(spark, sf_dir):
    job = run(spark, sf_dir)
    cells = job.flags.groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.sum("core_flag").alias("n_core"))
    per_cell = cells.join(job.components, "gid", "left")
    per_cluster = per_cell.groupBy("cluster_id").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("cells"),
        F.count(F.when(F.col("n_core") > 0, 1)).alias("core_cells"),
        F.sum("n_core").alias("n_core"),
    )
    return per_cluster.agg(
        F.sum("n").alias("n_points"),
        F.sum("cells").alias("n_cells"),
        F.sum("core_cells").alias("n_core_cells"),
        F.count("cluster_id").alias("n_clusters"),
        F.sum("n_core").alias("n_core"),
    )


# Overlapping partitions


def _located(spark, sf_dir, name: str = "emb3"):
    points, features = point_set(spark, sf_dir, name)
    placed, grid = locate(points, features, EPS[name], stable=name in PLAIN)
    return grid, placed, [PARTS] * len(features)


def _copies(spark, sf_dir, name: str = "emb3"):
    points, features = point_set(spark, sf_dir, name)
    return halo_points_of(points, features, EPS[name], [PARTS] * len(features), stable=name in PLAIN)


@query
def partition_bounds(spark, sf_dir):
    grid, _, parts = _located(spark, sf_dir)
    return halo.partition_edges(spark, grid, parts)


@query
def partition_home(spark, sf_dir):
    grid, placed, parts = _located(spark, sf_dir)
    return halo.home_partition(placed.select("gid", *grid.cells).distinct(), grid, parts).select("gid", "home")


@query
def halo_ids(spark, sf_dir):
    grid, placed, parts = _located(spark, sf_dir)
    cells = placed.select("gid", *grid.cells).distinct()
    return halo.replicate(cells, grid, parts).select("paid", "gid", "is_home")


@query
def halo_points(spark, sf_dir):
    return _copies(spark, sf_dir).select("paid", "gid", "point_id", "is_home")


@query
def partition_cells(spark, sf_dir):
    grid, placed, parts = _located(spark, sf_dir)
    cells = halo.replicate(placed.select("gid", *grid.cells).distinct(), grid, parts)
    return cells.groupBy("paid").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.min("gid").alias("first_cell"),
        F.max("gid").alias("last_cell"),
        F.sum(F.col("gid").cast("decimal(38,0)")).alias("sum_cells"),
    )


@query
def partition_cell_sets(spark, sf_dir):
    grid, placed, parts = _located(spark, sf_dir)
    return member_sets(halo.replicate(placed.select("gid", *grid.cells).distinct(), grid, parts), ["paid"], "gid")


@query
def partition_foreign_cells(spark, sf_dir):
    """How many cells a partition has that are at home in another one: all its cells without its own."""
    grid, placed, parts = _located(spark, sf_dir)
    copies = stage(halo.replicate(placed.select("gid", *grid.cells).distinct(), grid, parts).select("paid", "gid", "is_home"), "copies")
    every, home = (member_sets(df, ["paid"], "gid") for df in (copies, copies.filter("is_home = 1")))
    return set_sizes(combine_sets(every, home, ["paid"], "minus"), ["paid"]).withColumnRenamed("n_members", "n_foreign")


@query
def partition_load(spark, sf_dir):
    return halo.partition_load(_copies(spark, sf_dir))


@query
def merge_flags(spark, sf_dir):
    grid, placed, parts = _located(spark, sf_dir)
    features = list(grid.features)
    copies = halo.replicate(placed, grid, parts)
    seen = neighbors.core_sites(copies, features, grid.eps, MIN_PTS, scope=["paid"])
    flags = neighbors.to_points(copies, grid.attach_gid(seen, "uid"), features, ["paid"])
    return halo.merge_flags(flags)


# Exact baseline and evaluation


@query
def dbscan_exact(spark, sf_dir):
    points, features = point_set(spark, sf_dir, "emb3")
    return exact_dbscan(points, features, EPS["emb3"], MIN_PTS)


@query
def dbscan_exact_part2(spark, sf_dir):
    points, features = point_set(spark, sf_dir, "part2")
    return exact_dbscan(points, features, EPS["part2"], MIN_PTS, stable=True)


@query
def dbscan_exact_emb64(spark, sf_dir):
    points, features = point_set(spark, sf_dir, "emb64")
    return exact_dbscan(points, features, EPS["emb64"], MIN_PTS, stable=True)


def _compared(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    points, features = point_set(spark, sf_dir, "emb3")
    return compare_labels(points, features, EPS["emb3"], MIN_PTS), features


@query
def label_compare(spark, sf_dir):
    return _compared(spark, sf_dir)[0]


@query
def contingency(spark, sf_dir):
    return metrics.contingency(_compared(spark, sf_dir)[0], "cluster_id", "exact_cluster")


@query
def ari(spark, sf_dir):
    table = metrics.contingency(_compared(spark, sf_dir)[0], "cluster_id", "exact_cluster")
    return metrics.ari(table).select(F.round("ari", 6).alias("ari"))


@query
def ami(spark, sf_dir):
    table = stage(metrics.contingency(_compared(spark, sf_dir)[0], "cluster_id", "exact_cluster"), "contingency")
    return metrics.ami(table).select(F.round("ami", 6).alias("ami"))


@query
def silhouette(spark, sf_dir):
    df, features = _compared(spark, sf_dir)
    return silhouettes.silhouette(df, features, "cluster_id").select(F.round("silhouette", 6).alias("silhouette"))


@query
def silhouette_grouped(spark, sf_dir):
    df, features = _compared(spark, sf_dir)
    found = silhouettes.silhouette(df, features, "cluster_id", theta=0.2)
    return found.select(F.round("silhouette", 3).alias("silhouette"), "mode", F.round("error_bound", 6).alias("error_bound"))


@query
def evaluation(spark, sf_dir):
    df, features = _compared(spark, sf_dir)
    found = evaluate(df, features, "cluster_id", "exact_cluster")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


QUERIES["evaluate"] = QUERIES.pop("evaluation")
