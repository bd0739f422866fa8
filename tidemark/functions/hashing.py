"""Stable buckets, samplers and seeds from hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10)


def bucket(text: Column, n: int = 10_000) -> Column:
    """First 8 hex digits of the SHA-256, modulo n."""
    return _hex(text, 8).cast("long") % n


def sampler(text: Column, n: int = 10_000) -> Column:
    """First 16 hex digits, modulo n; they exceed a long."""
    return (_hex(text, 16).cast("decimal(20,0)") % F.lit(n).cast("decimal(20,0)")).cast("long")


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as an unsigned 32-bit number in a long."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.hex(F.substring(F.encode(text, "UTF-8"), i, F.lit(1))), 16, 10).cast("long"))
    start = F.lit(0x811C9DC5).cast("long")
    step = F.aggregate(codes, start, lambda h, b: (h.bitwiseXOR(b) * F.lit(0x01000193).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.when(F.octet_length(text) > 0, step).otherwise(start)
