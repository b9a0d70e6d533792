import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    local = tempfile.mkdtemp(prefix="cotejo-tests-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"{local}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{local}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return con


@pytest.fixture
def same(spark, duck):
    """Compares a query's rows on the small tables with its SQL's."""

    def check(query, sql):
        df = query(spark, SMALL)
        names = sorted(df.columns)
        ours = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
        result = duck.execute(sql)
        columns = [c[0] for c in result.description]
        order = [columns.index(c) for c in names]
        theirs = sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
        assert sorted(columns) == names
        assert ours == theirs
        return len(ours)

    return check
