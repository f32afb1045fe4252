"""Every registered query with SQL, run by Spark and by DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lumenfold.plans import registry
from lumenfold.sources import TABLES

SMALL = os.environ.get("LUMENFOLD_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(x) -> str:
        if pd.isna(x):
            return "null"
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
