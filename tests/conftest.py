import duckdb
import pytest
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.default.parallelism": "4"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for n in TABLES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    return c


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.fixture(scope="session")
def same(spark, duck, sf):
    """Whether a plan and its SQL give the same rows, whatever their order."""

    def run(plan, sql):
        df = plan(spark, sf)
        names = sorted(df.columns)
        mine = sorted(repr([cell(r[c]) for c in names]) for r in df.collect())
        got = duck.sql(sql)
        at = [got.columns.index(c) for c in names]
        assert sorted(got.columns) == names
        theirs = sorted(repr([cell(r[i]) for i in at]) for r in got.fetchall())
        assert mine == theirs
        return len(mine)

    return run
