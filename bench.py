"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
BENCH_QUERIES comma-separated subset (default: the headline queries)
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clusters", "clusters_emb4", "clusters_part2", "clusters_cust1", "clusters_user2", "neighbor_counts",
    "neighbor_cells_seeded", "cell_min_dist", "components", "border_eps", "labels_filled", "merge_flags",
    "partition_load", "dbscan_exact", "dbscan_exact_part2", "silhouette", "evaluate",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from densegrid import clear_staged
    from densegrid.queries import QUERIES

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("densegrid-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="densegrid-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("data_bounds", "clusters_supp2"):  # warm-up: code paths and the JVM
        QUERIES[name](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    clear_staged(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
