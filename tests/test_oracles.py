"""Every query with an SQL counterpart gives the same rows on the smallest data; the others run and have columns."""

import datetime
import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(FOLDER + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def _cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, (bool, str)):
        return str(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(pd.Timestamp(x).tz_localize(None) if getattr(x, "tzinfo", None) else pd.Timestamp(x))
    try:
        return repr(round(float(x), 6) + 0.0)
    except (TypeError, ValueError):
        return str(x)


def _rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(v) for v in r) for r in df[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert _rows(QUERIES[name](spark, FOLDER).toPandas()) == _rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not n[0] == "p" or not n[1].isdigit()))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert len(df.columns) == len(set(df.columns)) and df.count() >= 0
