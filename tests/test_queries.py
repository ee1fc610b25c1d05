"""Every query against its SQL, on the smallest test tables."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal | float):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime | datetime.date):
        return str(v)[:26].replace(" 00:00:00", "")
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_equal_to_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    out = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in out.fetchall())
    assert got == want


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
