"""Order-free fingerprints of tables: equal for equal multisets of rows, however they are dealt and in whatever order they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_text(*columns: str) -> Column:
    """Values with their lengths before them, so that no two rows share a text; null differs from empty."""
    parts = []
    for c in columns:
        s = F.col(c).cast("string")
        parts += [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("~")), F.lit("|")]
    return F.concat(*parts)


def row_hash(text: Column) -> Column:
    """60 bits of MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fold(hashed: Column) -> Column:
    """The fingerprint of a group's hashes: count, sum and exclusive or, none of which knows an order; partial in every task."""
    return F.concat_ws(":", F.count(hashed).cast("string"), F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string"), F.coalesce(F.bit_xor(hashed), F.lit(0)).cast("string"))


def table_fingerprint(df: DataFrame, *by: str) -> DataFrame:
    """by and the fingerprint of the other columns of their rows."""
    return df.groupBy(*by).agg(fold(row_hash(row_text(*(c for c in df.columns if c not in by)))).alias("print"))


# The same in SQL.
def sql_text(*columns: str) -> str:
    return " || '|' || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '~')" for c in columns) + " || '|'"


def sql_fold(text: str) -> str:
    h = f"('0x' || substr(md5({text}), 1, 15))::BIGINT"
    return f"count({h})::VARCHAR || ':' || coalesce(sum({h}), 0)::VARCHAR || ':' || coalesce(bit_xor({h}), 0)::VARCHAR"
