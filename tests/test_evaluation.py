"""Offline evaluation: how often its tables travel, and behaviours of odd rows."""

import os

import pytest

from tidemark import plans

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.mark.parametrize("name, most", [("evaluation_decision", 6), ("replay_comparison", 2), ("outcome_attribution", 2)])
def test_lines_travel_once_for_replays_and_once_for_outcomes(spark, name, most):
    """Two tables a pass, and what is told of members at the end; no shuffle by position, by entity or of both sides of a replay."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        plan = plans.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") <= most


def test_behaviours_of_odd_rows(spark, tmp_path):
    """Orders that occur twice, and lines and orders with nulls, as in SQL."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    orders, lines = (f"read_parquet('{DIR}/{n}.parquet')" for n in ("orders", "lineitem"))
    odd = {
        "orders": f"SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS o_custkey) FROM {orders} UNION ALL SELECT * FROM {orders} WHERE o_orderkey % 5 = 0",
        "lineitem": f"SELECT * REPLACE (CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_partkey END AS l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity) FROM {lines}",
    }
    for n, sql in odd.items():
        c.execute(f"COPY ({sql}) TO '{tmp_path}/{n}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{tmp_path}/{n}.parquet')")
    got = {r["category"]: r["n"] for r in plans.QUERIES["outcome_attribution"](spark, str(tmp_path)).collect()}
    assert got == dict(c.execute(f"SELECT category, n FROM ({plans.ORACLES['outcome_attribution']})").fetchall())
