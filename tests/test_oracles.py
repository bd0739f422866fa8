"""Queries that have SQL against that SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 5) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def names():
    from tidemark import plans

    return sorted(plans.ORACLES)


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from tidemark import plans

    df = plans.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(cols).collect())
    r = con.execute(plans.ORACLES[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == cols
    assert sorted(tuple(norm(x[at.index(c)]) for c in cols) for x in r.fetchall()) == got


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_query_is_empty():
    """A comparison of nothing with nothing proves nothing: on tables ten times as large every query has rows."""
    from tidemark import plans

    larger = "/root/testdata/sf0.01"
    if not os.path.isdir(larger):
        pytest.skip("no tables")
    c = duckdb.connect()
    for p in glob.glob(f"{larger}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    assert [n for n in names() if not c.execute(f"SELECT count(*) FROM ({plans.ORACLES[n]})").fetchone()[0]] == []
