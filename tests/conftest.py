import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(duck):
    """Holds a DataFrame against SQL: the same column names and rows, in any order."""

    def check(df, sql):
        got = duck.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(df.columns) == sorted(names)
        want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in got.fetchall())
        have = sorted(repr(tuple(r[df.columns.index(c)] for c in sorted(names))) for r in df.collect())
        assert have == want

    return check
