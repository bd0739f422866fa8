"""Canonical JSON as column expressions: keys as the type orders them, no spaces, numbers as scripts write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, StringType, StructType


def number(x: Column) -> Column:
    """Zeros of either sign as 0, whole numbers without a point, exponents with a small e and no plus. Not finite: null."""
    text = x.cast("double").cast("string")
    power = F.translate(F.regexp_replace(text, r"\.0(?=E)", ""), "E", "e")
    text = F.when(text.contains("E"), power).when(text.endswith(".0"), F.left(text, F.length(text) - 2)).otherwise(text)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).when(x == 0, "0").otherwise(text)


def negative_zero(x: Column) -> Column:
    """Whether x is zero with a minus; null where x is."""
    return (x == 0) & (x.cast("double").cast("string") == "-0.0")


def quoted(text: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, everything else as it is."""
    plain = F.regexp_replace(text, r'(["\\])', r"\\$1")

    def each(c: Column) -> Column:
        short = F.when(c == "\n", r"\n").when(c == "\t", r"\t").when(c == "\r", r"\r").when(c == "\b", r"\b").when(c == "\f", r"\f")
        return short.when(c < " ", F.concat(F.lit(r"\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c)

    rare = F.array_join(F.transform(F.split(plain, ""), each), "")
    escaped = F.when(text.rlike(r"[\x00-\x1f]"), rare).otherwise(plain)
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(text), F.lit('"'))


def written(parts: dict[str, Column]) -> Column:
    """An object of values that are JSON texts already; null where one of them is."""
    return F.concat(F.lit("{"), *(x for i, (k, v) in enumerate(parts.items()) for x in (F.lit(("," if i else "") + f'"{k}":'), v)), F.lit("}"))


def listed(texts: Column) -> Column:
    """A list of values that are JSON texts already; null where one of them is."""
    return F.when(~F.exists(texts, lambda e: e.isNull()), F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))


def canonical(x: Column, of: DataType) -> Column:
    """x of the given type as JSON text. Nulls are written, at any depth. A number that isn't finite makes the whole text null."""
    if isinstance(of, StructType):
        text = written({f.name: canonical(x[f.name], f.dataType) for f in of.fields})
    elif isinstance(of, ArrayType):
        text = listed(F.transform(x, lambda e: canonical(e, of.elementType)))
    elif isinstance(of, (DoubleType, FloatType)):
        text = number(x)
    elif isinstance(of, StringType):
        text = quoted(x)
    else:
        text = x.cast("string") if not isinstance(of, BooleanType) else F.when(x, "true").otherwise("false")
    return F.when(x.isNull(), "null").otherwise(text)


def digest(x: Column, of: DataType) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical(x, of), 256)
