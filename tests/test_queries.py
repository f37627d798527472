"""Every registered query of the library against its SQL, on whole tables."""

import pytest
from compare import DATA, database, duck_rows, spark_rows

import __spark_entry__ as contract
from densegrid import oracles
from densegrid.queries import QUERIES

SF = "sf0.01"
ORACLES = oracles.build()


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(ORACLES) <= set(contract.oracle_sql()) and set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, f"{DATA}/{SF}")
    columns, rows = spark_rows(df)
    assert rows
    wanted_columns, wanted = duck_rows(con, ORACLES[name])
    assert columns == wanted_columns
    assert rows == wanted


def test_entry(spark):
    assert contract.entry(spark).count() == 218
