"""The corpus pipeline: quality rules, near-duplicates, personal data, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents; the last returns the pieces of
packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash_dedup, mixing, packing, pii, quality_rules
from tidemark.llm.common import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy passes."""
    rows = docs.withColumn("_row", F.struct(*docs.columns))
    # a generator rather than a filter, which the optimizer would push down with every measurement written out in it
    return quality_rules.ledger(rows, keep=("_row",)).select(F.inline(F.when(quality_rules.passes(), F.array("_row"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash_dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by its kind; n_chars counts the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
