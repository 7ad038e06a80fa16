import os
import sys

import pytest
from pyspark.sql import SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join([REPO, os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)
DATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest folder of tables."""
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(small)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return con


def _norm(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


@pytest.fixture(scope="session")
def same():
    """Holds a DataFrame against rows of DuckDB: names, number and values."""

    def check(df, con, sql):
        found = con.sql(sql)
        names = sorted(found.columns)
        assert sorted(df.columns) == names
        at = [found.columns.index(c) for c in names]
        theirs = sorted(tuple(_norm(r[i]) for i in at) for r in found.fetchall())
        ours = sorted(tuple(_norm(r[c]) for c in names) for r in df.collect())
        assert ours == theirs

    return check
