import collections
import datetime
import decimal
import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def value(x):
    """A value in a form that both engines give."""
    if x is None or isinstance(x, (str, bool)):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat(" ")
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (float, decimal.Decimal)):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6) + 0.0
    return float(x) if isinstance(x, int) else x


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(value(r[i]) for i in order) for r in rows)


def views(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


def differences(df, sql, con):
    """What only Spark, and what only DuckDB returns."""
    got = bag(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    want = bag(names, cur.fetchall())
    return list((got - want).items())[:3], list((want - got).items())[:3], sum(got.values())


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    return views(SF)
