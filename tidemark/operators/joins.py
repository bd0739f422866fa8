"""As-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: list[str], at: str, time: str, ties: str, strict: bool = False) -> DataFrame:
    """Each row of left with the latest row of right whose `time` isn't after `at` (strict: is before); none: nulls.

    Both sides go through one sort per key: right rows are carried forward over left rows by a running last value, so the
    work is linear in the rows of a key, where a join would meet every pair. Left rows keep their columns.
    """
    carried = [c for c in right.columns if c not in on]
    r = right.select(*on, F.col(time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.struct(*carried).alias("_r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"), F.col(ties).alias("_tie"))
    row = left.select(*on, F.col(at).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.select(F.struct(*carried)).schema[0].dataType).alias("_r"), F.struct("*").alias("_l"), F.lit(None).cast(right.schema[ties].dataType).alias("_tie"))
    w = Window.partitionBy(*on).orderBy("_t", "_side", F.asc_nulls_first("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(row).withColumn("_last", F.last("_r", ignorenulls=True).over(w))
    return both.filter("_l is not null").select("_l.*", *(F.col("_last")[c].alias(c) for c in carried))
