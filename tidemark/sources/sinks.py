"""Sinks: append-only, insert-if-absent, newest-version and rebuild writes, and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines of a cluster see. Where it is unset, a new local folder if the session runs on this machine alone; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: its lineage ends there, and any executor can read it."""
    path = f"{shared_folder(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def insert_if_absent(df: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """The rows of df whose key isn't there yet, one per key."""
    return df.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """existing after changes that only a higher version may replace."""
    w = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("_new"))
    both = existing.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def purge(df: DataFrame, expired: str) -> tuple[DataFrame, int]:
    """What stays, and how many rows went."""
    gone = F.coalesce(F.expr(expired), F.lit(False))
    return df.filter(~gone), df.filter(gone).count()


def orphans(projection: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a projection whose source is gone."""
    return projection.join(source.select(*key), key, "left_anti")


def read_fixture(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated file with a header, or a JSON file, with a declared schema."""
    if path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)
