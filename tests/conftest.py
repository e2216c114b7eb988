import math
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and math.isnan(value) else value


@pytest.fixture(scope="session")
def agree(duck):
    """Asserts that a DataFrame and an oracle query have the same columns and the same rows, in any order."""

    def check(df, sql):
        columns = sorted(df.columns)
        ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
        got = duck.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in got.fetchall())
        assert ours == theirs

    return check
