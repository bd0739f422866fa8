"""Joins with one row per key, whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys broadcast at most, and rows of a key from which it can be one.
HOT_KEYS, HOT = 500_000, 4_096


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """The inner join of rows with keyed, one row per key, where `n` of keyed says how many rows have the key and `total` how many there are.

    Keys of many rows are joined by a broadcast, so their rows stay where they are; at most HOT_KEYS keys are such, as their rows add up to
    `total` at most. The others are joined by a shuffle. keyed is read twice: a staged or checkpointed table."""
    many = max(HOT, -(-total // HOT_KEYS))
    hot = F.broadcast(keyed.filter(F.col(n) >= many))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(keyed.filter(F.col(n) < many), on))


def left_counted(rows: DataFrame, keyed: DataFrame, on: list[str], n: str) -> DataFrame:
    """The left join of rows with keyed, one row per key, where `n` of keyed says how many rows have the key. keyed is a staged or checkpointed table.

    Where any keys have many rows, they are joined by a broadcast; as `join_counted` counts them."""
    total = keyed.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"]
    many = max(HOT, -(-total // HOT_KEYS))
    hot = keyed.filter(F.col(n) >= many)
    if not hot.limit(1).count():
        return rows.join(keyed, on, "left")
    hot = F.broadcast(hot)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(keyed.filter(F.col(n) < many), on, "left"))
