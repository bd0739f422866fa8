"""What the corpus operators share: the cluster's shared folder, staged tables, small column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import shared_folder as shared_dir

#: Words are maximal runs of characters other than these.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: the lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """As `stage`, with aggregates of the rows that the same job gathers. Only aggregates that a repeated task doesn't change, such as max."""
    seen = Observation()
    return stage(df.observe(seen, *(c.alias(n) for n, c in metrics.items())), name), seen.get


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder; for the small tables of loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of a table of hot keys at most, and members from which a key can be one.
HOT_KEYS, HOT = 500_000, 4_096


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """The inner join of rows with keyed, one row per key, where `n` of keyed is the number of rows of the key and `total` that of all.

    Keys with many rows are joined by a broadcast, so they stay spread as they are; there are no more than HOT_KEYS of them, as together
    they have at most `total` rows. The others are joined by a shuffle. keyed is read twice: it should be a staged table."""
    many = max(HOT, -(-total // HOT_KEYS))
    hot = F.broadcast(keyed.filter(F.col(n) >= many))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(keyed.filter(F.col(n) < many), on))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)
