import os

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[4]").appName("tests")
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "3g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
    }
    for k, v in conf.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.fixture(scope="session")
def compare(duck):
    """Fails unless a DataFrame has the columns and rows of a query in DuckDB, in any order; floats to 12 digits."""

    def plain(x):
        return float(f"{x:.12g}") if isinstance(x, float) else x

    def run(df, sql):
        q = duck.execute(sql)
        names = [d[0] for d in q.description]
        assert sorted(names) == sorted(df.columns)
        a = sorted(repr([plain(r[n]) for n in sorted(names)]) for r in df.collect())
        b = sorted(repr([plain(r[names.index(n)]) for n in sorted(names)]) for r in q.fetchall())
        assert a == b

    return run
