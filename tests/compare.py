"""Compare a Spark result with a DuckDB result: columns by name, rows in any order."""

import math
import os

import duckdb

DATA = "/root/testdata"


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    folder = f"{DATA}/{sf}"
    for name in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.12g}")
        return v

    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), normal(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return sorted(columns), normal(columns, found.fetchall())
