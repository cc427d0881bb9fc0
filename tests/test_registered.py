"""Every registered query against its DuckDB counterpart."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from matchloom.plans.registered import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(df: pd.DataFrame):
    def plain(v):
        missing = v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v))
        return "∅" if missing else str(v)

    ordered = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in ordered.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = entry_points.queries()[name](spark, SF).toPandas()
    want = duck.execute(entry_points.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
