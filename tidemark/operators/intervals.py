"""Joins of intervals with the points inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_left_join(left: DataFrame, right: DataFrame, on: list[str], key: list[str], lo: str, hi: str, at: str, width: int) -> DataFrame:
    """Each row of left with every row of right that agrees in `on` and has lo <= at < hi; rows of left without one stay, with nulls.

    key tells left's rows apart; lo, hi and at are timestamps; right's other columns are added. Both sides are cut into buckets of `width` seconds, a left row
    lying in all that its interval meets, and meet by (on, bucket): a user with very many points is spread over time, and a
    pair meets once, as a point is in one bucket. Null ends make no interval: such rows have no match. Choose width about as long as the intervals."""
    second = lambda c: F.expr(f"floor(unix_micros({c}) / 1000000 / {width})").cast("long")
    first, last = second(lo), F.expr(f"floor((unix_micros({hi}) - 1) / 1000000 / {width})").cast("long")
    open_ = left.filter((F.col(lo) < F.col(hi)) & F.col(lo).isNotNull() & F.col(hi).isNotNull()).withColumn("_bucket", F.explode(F.sequence(first, last)))
    points = right.withColumn("_bucket", second(at))
    more = [c for c in right.columns if c not in on]
    pairs = open_.join(points, [*on, "_bucket"]).filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).select(*left.columns, *more)
    alone = left.join(pairs.select(*key).distinct(), key, "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)
