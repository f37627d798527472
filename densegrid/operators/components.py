"""Connected components by star contraction (Kiveris et al., SoCC 2014) on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densegrid.runtime import hot_join, release, stage, stage_told

EDGE = "src bigint, dst bigint"
#: Edges that a task holds at a time.
CHUNK_EDGES = 1_000_000


def _forest(chunk: int):
    """Build the task function; a closure, so executors need no copy of this package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replace chunks of edges by stars on the smallest id of each component inside the chunk."""
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                part = b.slice(at, chunk)
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
                n += part.num_rows
                if n >= chunk:
                    yield from stars(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if held:
            yield from stars(*map(np.concatenate, zip(*held)))

    def stars(src: np.ndarray, dst: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
        s, d = flat[: len(src)], flat[len(src):]
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label[s], label[d])
            new = label.copy()
            np.minimum.at(new, label[s], low)
            np.minimum.at(new, label[d], low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        leaf = np.flatnonzero(label != np.arange(len(ids)))
        for at in range(0, len(leaf), 65536):
            part = leaf[at: at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[part]]), pa.array(ids[part])], names=["src", "dst"])

    return run


def local_forest(edges: DataFrame, chunk: int = CHUNK_EDGES) -> DataFrame:
    """Shrink the edge set, ``chunk`` edges at a time, so memory is bounded; connectivity is unchanged."""
    return edges.select("src", "dst").mapInArrow(_forest(chunk), EDGE)


def large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to its smallest neighbour."""
    both = edges.union(edges.select(F.col("dst"), F.col("src")))
    lower = both.groupBy("src").agg(F.min("dst").alias("root")).filter(F.col("root") < F.col("src"))
    moved = hot_join(edges, lower, ["src"], "left")
    return moved.select(F.coalesce("root", "src").alias("src"), "dst").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them."""
    lowest = edges.groupBy("dst").agg(F.min("src").alias("root"))
    siblings = hot_join(edges, lowest, ["dst"]).filter(F.col("src") != F.col("root"))
    return (
        lowest.select(F.col("root").alias("src"), "dst")
        .union(siblings.select(F.col("root").alias("src"), F.col("src").alias("dst")))
        .distinct()
    )


def is_star(edges: DataFrame) -> bool:
    """Every node is either a root or hangs on exactly one root."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select(F.col("dst"), F.lit(0), F.lit(1))
    )
    degree = ends.groupBy("id").agg(F.max("up").alias("up"), F.sum("down").alias("down"))
    return degree.filter((F.col("down") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def connected_components(vertices: DataFrame, edges: DataFrame, chunk: int = CHUNK_EDGES) -> DataFrame:
    """``(id, component)`` for every vertex; the component is named by its smallest id.

    Partitions follow from the number of edges; the star rounds run until the edges are stars, at every size.
    """
    oriented = edges.select(
        F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    ).filter("src < dst")
    oriented, told = stage_told(oriented, "edges")
    parts = max(1, -(-told["rows"] // chunk))
    spread = oriented.repartitionByRange(parts, "src") if parts > 1 else oriented.coalesce(1)
    stars = stage(local_forest(spread, chunk), "stars")
    # What one chunk holds comes out of it as stars.
    done = parts == 1
    while not done and not is_star(stars):
        wide = stage(large_star(stars), "stars")
        narrow = stage(small_star(wide), "stars")
        release(stars, wide)
        stars = narrow
    found = stars.select(F.col("dst").alias("id"), F.col("src").alias("component"))
    return vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def extend_components(known: DataFrame, edges: DataFrame) -> DataFrame:
    """``known(id, component)`` after ``edges`` between its ids are added; the same labels as a run on all edges.

    The new edges are mapped to the components that they connect, and only these, as far as they differ, are solved
    again. ``known`` should be a staged table. A component keeps the name of its smallest id.
    """
    def mapped(df: DataFrame, end: str) -> DataFrame:
        names = known.select(F.col("id").alias(end), F.col("component").alias(f"{end}_in"))
        return hot_join(df, names, [end])

    between = mapped(mapped(edges.select("src", "dst"), "src"), "dst").select(
        F.least("src_in", "dst_in").alias("src"), F.greatest("src_in", "dst_in").alias("dst")
    )
    between, told = stage_told(between.filter("src < dst").distinct(), "contracted")
    if not told["rows"]:
        return known
    ends = between.select(F.col("src").alias("id")).union(between.select("dst")).distinct()
    solved = connected_components(ends, between).select(F.col("id").alias("component"), F.col("component").alias("merged"))
    return hot_join(known, stage(solved, "merged"), ["component"], "left").select(
        "id", F.coalesce("merged", "component").alias("component")
    )
