"""Point tables ``(point_id, x0, x1, ..)`` read from parquet.

Only the key and the feature columns reach the scan. The index of a point is its natural key; ``index``
numbers points 0, 1, .. along an order where positions are wanted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from densegrid.runtime import number_rows


def feature_names(d: int) -> list[str]:
    return [f"x{k}" for k in range(d)]


def load(spark: SparkSession, path: str, key: str, features: list[str | Column]) -> DataFrame:
    """Read a parquet table as points; ``features`` are column names or expressions."""
    columns = [F.col(f) if isinstance(f, str) else f for f in features]
    return spark.read.parquet(path).select(
        F.col(key).cast("bigint").alias("point_id"),
        *[c.cast("double").alias(n) for c, n in zip(columns, feature_names(len(columns)))],
    )


def _vectors(spark: SparkSession, path: str, key: str, column: str, n: int) -> DataFrame:
    """``(point_id, v)``; a row whose array does not have ``n`` elements is an error."""
    wrong = F.raise_error(F.concat(F.lit(f"{column} should have {n} elements, not "), F.size(column).cast("string")))
    table = spark.read.parquet(path).filter(F.when(F.size(column) == n, F.lit(True)).otherwise(wrong))
    return table.select(F.col(key).cast("bigint").alias("point_id"), F.col(column).alias("v"))


def from_array(spark: SparkSession, path: str, key: str, column: str, d: int) -> DataFrame:
    """Points from an array column of ``d`` elements; a row with another number of elements is an error."""
    vectors = _vectors(spark, path, key, column, d)
    return vectors.select("point_id", *[F.col("v")[k].cast("double").alias(f) for k, f in enumerate(feature_names(d))])


def signed(k: int, j: int) -> int:
    """Sign of element ``j`` in sum ``k``: rows of a Hadamard matrix, so the sums are independent directions."""
    return -1 if bin(k & j).count("1") % 2 else 1


def signed_sums(spark: SparkSession, path: str, key: str, column: str, n: int, d: int) -> DataFrame:
    """Points of ``d`` features, each a signed sum of all ``n`` elements over sqrt(n), added up from the left.

    A row with another number of elements is an error. The sums are computed where they are read: callers that read
    them more than once should stage them.
    """
    table = _vectors(spark, path, key, column, n)
    sums = []
    for k in range(1, d + 1):
        # A loop over a constant array, not one term per element: code that refers to a sum stays small.
        signs = F.array(*[F.lit(float(signed(k, j))) for j in range(n)])
        terms = F.zip_with("v", signs, lambda x, s: x.cast("double") * s)
        sums.append(F.aggregate(terms, F.lit(0.0), lambda total, x: total + x) / F.lit(math.sqrt(n)))
    return table.select("point_id", *[c.alias(f) for c, f in zip(sums, feature_names(d))])


def index(points: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """Add the 0-based position of each point along ``order``."""
    return number_rows(points, order, out)


ELEMENTS = 64


def emb(spark: SparkSession, sf_dir: str, d: int) -> DataFrame:
    """Whole vectors for d = 64, else ``d`` signed sums over all elements."""
    path = f"{sf_dir}/embeddings.parquet"
    if d == ELEMENTS:
        return from_array(spark, path, "vec_id", "embedding", d)
    return signed_sums(spark, path, "vec_id", "embedding", ELEMENTS, d)


def part2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, f"{sf_dir}/part.parquet", "p_partkey", ["p_size", "p_retailprice"])


def cust1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, f"{sf_dir}/customer.parquet", "c_custkey", ["c_acctbal"])


def supp2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(
        spark, f"{sf_dir}/supplier.parquet", "s_suppkey", [F.col("s_acctbal") / F.lit(1000.0), "s_nationkey"]
    )


def order2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per customer: orders, and orders that are finished; null where there is none of those."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    done = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    return orders.groupBy(F.col("o_custkey").cast("bigint").alias("point_id")).agg(
        F.count(F.lit(1)).cast("double").alias("x0"), F.when(done > 0, done.cast("double")).alias("x1")
    )


def user2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point per user of the event stream: mean value, from an exact sum, and number of events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.col("user_id").cast("bigint").alias("point_id")).agg(
        (F.sum(F.col("value").cast("decimal(38,6)")).cast("double") / F.count("value")).alias("x0"),
        F.count(F.lit(1)).cast("double").alias("x1"),
    )
