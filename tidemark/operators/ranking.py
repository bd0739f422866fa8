"""Row numbers within few large groups, without a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stage


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with its rows numbered from 1 within each group by order (of columns of df).

    Rows are dealt to ranges of (group, order) and written there once, numbered within their range, and moved up by what earlier
    ranges hold of the group. No more groups go on from range to range than there are ranges, so those counts can be
    broadcast. Rows alike in group and order share a range, in any order: end `order` with a column that tells rows apart.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(df.repartitionByRange(n, *(F.col(c).asc_nulls_first() for c in group), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    held = dealt.groupBy("_range", *group).agg(F.count("*").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    moved = held.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), before.alias("_before")).filter("_before > 0")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)), F.col("_range") == F.col("_r"))
    rows = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order)))
    return rows.join(F.broadcast(moved), same, "left").select(*df.columns, (F.col("_n") + F.coalesce("_before", F.lit(0))).alias(name))
