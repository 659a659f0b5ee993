"""Every relational, signal and streaming query against its DuckDB oracle."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from sigloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(names, found):
    return sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_open_sessions_are_withheld(spark):
    streamed = QUERIES["stream_sessions"](spark, SF)
    batch = QUERIES["session_windows"](spark, SF)
    assert streamed.exceptAll(batch.select(*streamed.columns)).isEmpty()
    assert 0 < streamed.count() <= batch.count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("hint", "node"), [("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("broadcast", "BroadcastHashJoin"), ("shuffle_replicate_nl", "CartesianProduct")])
def test_hints_choose_the_join(spark, hint, node):
    assert node in plan_of(QUERIES[f"join_hint_{hint}"](spark, SF))


def test_late_rows_are_missing(spark, con):
    """The stream that drops late rows counts fewer than the one that has none."""
    total = lambda name: sum(r.n for r in QUERIES[name](spark, SF).collect())
    assert total("stream_late") < total("stream_hourly_append")
