"""Text expressions shared by the operators; JVM functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words after lower-casing A-Z: maximal runs of 0-9, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """``text`` with A-Z lower-cased and everything else as it is; null is empty.

    Pure ASCII text takes Spark's fast ``lower``, which does the same there.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """Array of the words of ``text`` in order."""
    return F.regexp_extract_all(lower_az(text), F.lit(WORD), F.lit(0))
