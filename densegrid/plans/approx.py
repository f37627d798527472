"""Grid-based approximate density clustering."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegrid.functions.geometry import prefixed
from densegrid.operators.balls import connecting_links, lowest_cluster
from densegrid.operators.components import connected_components
from densegrid.operators.grid import Grid, checked_points
from densegrid.operators.links import link_cells
from densegrid.operators.neighbors import MAX_BINNED, core_sites, near, search_keys, to_points
from densegrid.runtime import hot_join, stage


@dataclass
class ApproxClustering:
    """The stages of one run; each is computed on first use and shared by the later ones.

    ``invalid`` says what happens to points with missing or infinite features: ``raise`` or ``drop``. The points are
    read several times, so they are staged first, unless they are ``stable``: a table, the same at every read.
    """

    points: DataFrame
    features: list[str]
    eps: float
    min_pts: int
    rho: float = 0.0
    rho_policy: str = "never"
    grid_kind: str = "stretched"
    border: str = "cell"
    cell_points: str = "core"
    rule: str = "strict"
    seed: int = 0
    invalid: str = "raise"
    stable: bool = False

    def __post_init__(self) -> None:
        self.points, self.features = checked_points(self.points, self.features, self.invalid)
        if not self.stable:  # an aggregate, say, may differ in the last bit when it is read again
            self.points = stage(self.points, "points")
        if self.border not in ("cell", "eps"):
            raise ValueError(f"unknown border mode {self.border!r}")
        if self.cell_points not in ("core", "all"):
            raise ValueError(f"unknown cell_points {self.cell_points!r}")

    @cached_property
    def grid(self) -> Grid:
        return Grid.fit(self.points, self.features, self.eps, self.grid_kind)

    @cached_property
    def sites(self) -> DataFrame:
        """Distinct coordinate vectors with ``gid`` and ``core_flag``."""
        flags = core_sites(self.points, self.features, self.eps, self.min_pts, self.rule)
        placed = self.grid.attach_gid(flags, "uid")
        return placed if self.grid.fits else stage(placed, "sites")

    @cached_property
    def n_sites(self) -> int:
        return self.sites.count()

    @cached_property
    def core(self) -> DataFrame:
        return self.sites.filter("core_flag = 1")

    @cached_property
    def flags(self) -> DataFrame:
        """``(point_id, gid, core_flag)`` for every point."""
        return to_points(self.points, self.sites, self.features).select("point_id", "gid", "core_flag")

    @cached_property
    def core_cells(self) -> DataFrame:
        """Cells with at least one core point: ``(gid, n_core)``."""
        return self.core.groupBy("gid").agg(F.sum("mult").alias("n_core"))

    @cached_property
    def core_cell_sites(self) -> DataFrame:
        """All sites of core cells, core or not."""
        return hot_join(self.sites, self.core_cells.select("gid"), ["gid"], "left_semi",
                        rows=self.n_sites)

    @cached_property
    def linked_points(self) -> DataFrame:
        source = self.core if self.cell_points == "core" else stage(self.core_cell_sites, "cell_sites")
        return source.select("gid", "uid", *self.features)

    @cached_property
    def edges(self) -> DataFrame:
        """Neighbouring core cells ``(src, dst)`` with ``src < dst``."""
        return link_cells(
            self.linked_points, self.features, self.eps, self.rho, self.rho_policy, self.seed, self.n_sites
        )

    @cached_property
    def components(self) -> DataFrame:
        """``(gid, cluster_id)``; a cluster is named by its smallest cell."""
        vertices = self.core.select(F.col("gid").alias("id")).distinct()
        if len(self.features) > MAX_BINNED and self.rho_policy in ("never", "always"):
            # In many dimensions the neighbours of a cell are too many to list; some of them connect as much.
            pts = stage(self.linked_points, "linked")
            edges = connecting_links(pts, self.features, self.eps * (1 + self.rho) if self.rho_policy == "always" else self.eps)
        else:
            edges = self.edges
        return connected_components(vertices, edges).select(
            F.col("id").alias("gid"), F.col("component").alias("cluster_id")
        )

    @cached_property
    def cell_assigned(self) -> DataFrame:
        """Sites of core cells with the cluster of their cell."""
        return hot_join(self.sites, self.components, ["gid"], rows=self.n_sites)

    @cached_property
    def border_assigned(self) -> DataFrame:
        """Sites that are not core, with the smallest cluster among the core points within ``eps``."""
        keep = ["uid", "mult", *self.features, "gid", "core_flag"]
        rest = self.sites.filter("core_flag = 0").select(*keep)
        if len(self.features) > MAX_BINNED:
            owners = hot_join(self.core, self.components, ["gid"], rows=self.n_sites).select("uid", "cluster_id", *self.features)
            return rest.join(lowest_cluster(rest, stage(owners, "owners"), self.features, self.eps), "uid").select(*keep, "cluster_id")
        seen = prefixed("q_", self.features)
        owners = hot_join(self.core, self.components, ["gid"], rows=self.n_sites).select(
            *[F.col(f).alias(q) for f, q in zip(self.features, seen)], "cluster_id"
        )
        owners = stage(owners, "owners")
        dims = search_keys(self.sites, self.features)
        pairs = near(rest, owners, self.features, seen, self.eps, dims, rows=self.n_sites)
        return pairs.groupBy(*keep).agg(F.min("cluster_id").alias("cluster_id"))

    def clusters(self) -> DataFrame:
        """``(cluster_id, point_id, core_flag)`` for every clustered point."""
        columns = ["uid", "mult", *self.features, "core_flag", "cluster_id"]
        if self.border == "cell":
            assigned = self.cell_assigned.select(*columns)
        else:
            assigned = self.cell_assigned.filter("core_flag = 1").select(*columns).unionByName(
                self.border_assigned.select(*columns)
            )
        full = to_points(self.points, assigned, self.features, base=self.sites)
        return full.select("cluster_id", "point_id", "core_flag")


def approx_dbscan(points: DataFrame, features: list[str], eps: float, min_pts: int, rho: float = 0.0,
                  rho_policy: str = "never", **options) -> DataFrame:
    """Cluster ``points(point_id, features..)``; see :class:`ApproxClustering` for the options."""
    return ApproxClustering(points, features, eps, min_pts, rho, rho_policy, **options).clusters()
