import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config(map={"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"})
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compare a query's rows with those of its SQL, whatever their order."""

    def check(query, sql):
        df = query(spark, SF)
        columns = sorted(df.columns)
        got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
        cur = duck.execute(sql)
        names = [c[0] for c in cur.description]
        assert sorted(names) == columns
        want = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
        assert got == want

    return check
