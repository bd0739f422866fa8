"""Text functions that built-ins don't have, as Arrow-batched functions: Unicode forms, keyed hashes, canonical JSON, key scans."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = 128


def _plain(value):
    """Numbers as canonical JSON writes them: zero without a sign, whole numbers without a point."""
    if isinstance(value, float):
        return 0 if value == 0 else int(value) if value.is_integer() and abs(value) < 1e15 else value
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def canonical(text: str | None) -> str | None:
    """JSON with sorted keys and no spaces; null for what isn't JSON."""
    try:
        return None if text is None else json.dumps(_plain(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def has_key(text: str | None, forbidden: frozenset[str]) -> bool:
    """Whether a key at any depth, reduced to a-z and 0-9, is forbidden."""
    try:
        todo = [json.loads(text)] if text is not None else []
    except ValueError:
        return False
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if any(re.sub("[^a-z0-9]", "", k.lower()) in forbidden for k in x):
                return True
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return False


def normalise(text: str | None) -> str | None:
    """Trimmed, single spaces, NFKC, lower case."""
    return None if text is None else unicodedata.normalize("NFKC", " ".join(text.split())).lower()


def canonical_json(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(canonical)

    return run(column)


def contains_key(column: Column, *forbidden: str) -> Column:
    keys = frozenset(forbidden)

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: has_key(t, keys))

    return run(column)


def normalised_query(column: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(normalise)

    return run(column)


def hmac_bucket(column: Column, secret: bytes, n: int = 10_000) -> Column:
    """First four bytes of the HMAC-SHA256, modulo n; null stays null."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else int.from_bytes(hmac.new(secret, t.encode(), hashlib.sha256).digest()[:4], "big") % n).astype("Int64")

    return run(column)


def terms(column: Column, most: int = 64) -> Column:
    """Distinct lower-case runs of letters and digits in first-seen order, cut at TERM characters, at most `most`."""
    parts = F.transform(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda t: F.left(t, F.lit(TERM)))
    return F.slice(F.array_distinct(F.filter(parts, lambda t: t != "")), 1, most)
