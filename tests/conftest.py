import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from densegrid import clear_staged

    session = (
        SparkSession.builder.master("local[8]")
        .appName("densegrid-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_staged(session)
    session.stop()


@pytest.fixture
def skewed(spark):
    """Settings under which the skew paths run on a few hundred rows."""
    spark.conf.set("densegrid.hotRows", "20")
    spark.conf.set("densegrid.leafPairs", "50")
    yield spark
    spark.conf.unset("densegrid.hotRows")
    spark.conf.unset("densegrid.leafPairs")
