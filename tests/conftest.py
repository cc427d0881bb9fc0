import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from matchloom.plans.ship import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture
def keys_of(spark):
    """``key, pos`` rows from a list; the place in the list is the position."""
    return lambda values: spark.createDataFrame(list(zip(values, range(len(values)))), "key string, pos long")


def collect_pairs(df):
    """{pos_a: [(pos_b, raw), ...] by rank}"""
    out = {}
    for r in df.orderBy("pos_a", "rank").collect():
        out.setdefault(r["pos_a"], []).append((r["pos_b"], round(r["raw"], 7)))
    return out
