"""Session helpers: staged tables, hot-key detection, skew-safe joins and distributed numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

HOT_ROWS = "densegrid.hotRows"
LEAF_PAIRS = "densegrid.leafPairs"
DEFAULTS = {HOT_ROWS: 2_000_000, LEAF_PAIRS: 4096}

# A key is hot when it holds at least 1/50000 of the rows, so there are at most 50000 hot keys.
HOT_SHARE = 50_000

# Most rows of hot keys that are broadcast, and the shares of a key beyond that.
HOT_RIGHT = 200_000
SALTS = 64

_local_scratch: dict[str, str] = {}


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, str(DEFAULTS[name])))


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = chosen.get() if chosen.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        app = spark.sparkContext.applicationId
        base = _local_scratch.setdefault(app, "") or tempfile.mkdtemp(prefix="densegrid-")
        _local_scratch[app] = base
    return f"{base.rstrip('/')}/densegrid-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, survives executor loss, and gives later joins a columnar source with known size.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged = path
    return table


def stage_told(df: DataFrame, name: str, **told: Column) -> tuple[DataFrame, dict]:
    """``stage`` with statistics taken while the table is written: ``rows``, and aggregates under the names given.

    No further job is needed to learn whether a table is empty, how many rows it has, or its largest group.
    """
    seen = Observation()
    table = stage(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in told.items()]), name)
    return table, seen.get


def release(*tables: DataFrame) -> None:
    """Delete tables that ``stage`` returned, after their last use: what is read later must not come from them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._staged)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def clear_staged(spark: SparkSession) -> None:
    """Delete everything this application has staged. Call it when the results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame | None:
    """Keys of ``df`` that would overload one task, with their row ``count``; None when there are none.

    ``df`` should be cheap to scan twice (a staged table); ``rows`` is its row count, or an upper limit,
    when known. At most ``HOT_SHARE`` keys qualify, so the result is small enough to broadcast whatever
    the size of the data.
    """
    floor_rows = setting(df.sparkSession, HOT_ROWS)
    total = df.count() if rows is None else rows
    if total <= floor_rows:
        return None
    found, told = stage_told(df.groupBy(*keys).count().filter(F.col("count") >= hot_cut(floor_rows, total)), "hot")
    return found if told["rows"] else None


def hot_cut(floor_rows: int, total: int) -> int:
    """Rows from which a key is hot."""
    return max(floor_rows, -(-total // HOT_SHARE))


def hot_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Equi-join of a possibly skewed ``left`` with a ``right`` that has few rows per key.

    Rows with a hot key never meet in one task: they are joined in place with the few matching rows of
    ``right``, which are broadcast when there are at most ``HOT_RIGHT`` of them. More than that are joined by key
    and salt, each row of ``right`` repeated for every share of its key. All other rows take the shuffle join.
    """
    if hot is None:
        hot = hot_keys(left, on, rows)
    if hot is None:
        return left.join(right, on, how)
    marks = F.broadcast(hot.select(*on))
    few, told = stage_told(right.join(marks, on, "left_semi"), "few")
    heavy = left.join(marks, on, "left_semi")
    if told["rows"] <= HOT_RIGHT:
        heavy = heavy.join(F.broadcast(few), on, how)
    else:
        salt = F.pmod(F.xxhash64(*[c for c in left.columns if c not in on] or on), F.lit(SALTS))
        spread = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        heavy = heavy.withColumn("_salt", salt.cast("int")).join(spread, [*on, "_salt"], how).drop("_salt")
    light = left.join(marks, on, "left_anti").join(right, on, how)
    return heavy.unionByName(light)


def tiled_join(
    left: DataFrame, right: DataFrame, on: list[str], rows: tuple[int | None, int | None] = (None, None)
) -> DataFrame:
    """Inner join of two sides that may both have many rows of one key.

    A hot key is cut into shares of about ``hotRows`` rows on either side; every share of one side meets every share
    of the other under a key of its own. ``rows`` are upper limits of the row counts, when known.
    """
    chunk = setting(left.sparkSession, HOT_ROWS)
    counts = [hot_keys(side, on, n) for side, n in zip((left, right), rows)]
    if counts == [None, None]:
        return left.join(right, on)
    shares = None
    for name, found in zip(("_left", "_right"), counts):
        if found is not None:
            one = found.select(*on, F.ceil(F.col("count") / chunk).cast("int").alias(name))
            shares = one if shares is None else shares.join(one, on, "full")
    for name in ("_left", "_right"):
        shares = shares.withColumn(name, F.coalesce(name, F.lit(1)) if name in shares.columns else F.lit(1))
    few = F.broadcast(stage(shares, "shares"))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        rest = [c for c in side.columns if c not in on] or on
        n, m = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        return (
            side.join(few, on, "left")
            .withColumn(f"_at{own}", F.pmod(F.xxhash64(*rest), n).cast("int"))
            .withColumn(f"_at{other}", F.explode(F.sequence(F.lit(0), m - 1)))
            .drop("_left", "_right")
        )

    tiles = ["_at_left", "_at_right"]
    return dealt(left, "_left", "_right").join(dealt(right, "_right", "_left"), [*on, *tiles]).drop(*tiles)


def number_rows(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order``, without a single-task window.

    Rows are range-partitioned and sorted, numbered inside each partition, and shifted by the sizes of
    the partitions before. ``order`` should identify a row.
    """
    low_bits = (1 << 33) - 1
    ranged = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_tag", F.monotonically_increasing_id()),
        "ranged",
    )
    part = F.shiftright("_tag", 33)
    sizes = ranged.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    starts, seen = [], 0
    for row in sizes:
        starts.append((row["_part"], seen))
        seen += row["count"]
    local = F.col("_tag").bitwiseAND(F.lit(low_bits))
    if len(starts) <= 1:
        return ranged.withColumn(out, local).drop("_tag")
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_start") + local)
        .drop("_tag", "_part", "_start")
    )
