"""Density clustering of numeric points on Spark DataFrames."""

from densegrid.operators.labels import fill_labels
from densegrid.operators.neighbors import neighbor_counts
from densegrid.operators.sets import combine_sets, list_members, member_sets, set_sizes
from densegrid.operators.silhouette import silhouette
from densegrid.plans.approx import ApproxClustering, approx_dbscan
from densegrid.plans.evaluate import compare_labels, evaluate
from densegrid.plans.exact import exact_dbscan
from densegrid.plans.input import halo, locate
from densegrid.runtime import clear_staged

__all__ = [
    "ApproxClustering", "approx_dbscan", "clear_staged", "combine_sets", "compare_labels", "evaluate", "exact_dbscan",
    "fill_labels", "halo", "list_members", "locate", "member_sets", "neighbor_counts", "set_sizes", "silhouette",
]
