"""Where queries and their SQL are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Domain, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a function of a Domain; sql is the same query over the tables and the given views."""

    def add(f: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views) if views else sql
        return f

    return add
