"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule; a policy is
a versioned mask over those bits, so verdicts of any policy and the effect of leaving rules out are bitwise arithmetic
over the ledger and never touch the texts again. All of it is column expressions inside one scan, without a shuffle.

Defined results: a null or blank text has no words and fails `few_words`; repeated rows get a row each; an empty table
gives an empty ledger; other columns of the input are ignored unless they are asked for with `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, documents, text_or_empty

#: Rules in bit order: name and SQL condition over the measurements under which a document fails.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    ("shouting", "100 * n_upper > 40 * word_chars"),
    ("exclamations", "100 * n_exclaims > 30 * n_words"),
]
BASE_RULES = ("few_words", "repeated_words")


def mask(*names: str) -> int:
    order = [name for name, _ in RULES]
    return sum(1 << order.index(name) for name in set(names))


#: A policy never changes once it has a version; a new one gets a new key.
POLICIES: dict[str, int] = {
    "base-1": mask(*BASE_RULES),
    "strict-1": mask(*(name for name, _ in RULES)),
}
DEFAULT_POLICY = "strict-1"
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")


def _long(c: Column) -> Column:
    return c.cast("long")


def measure(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: `keep` and MEASUREMENTS.

    Repeated three-word windows are found per document by sorting the windows' 64-bit hashes together with their
    places, so the work grows as n log n with the words of a text.
    """
    t = text_or_empty(text)
    m = df.select(
        *keep,
        F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("_w"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(f"[^{SPACE}]")).alias("_lines"),
        _long(F.length(F.translate(t, " \t\n\x0b\x0c\r", ""))).alias("word_chars"),
        _long(F.regexp_count(t, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        _long(F.regexp_count(t, F.lit(r"\p{Lu}"))).alias("n_upper"),
        _long(F.regexp_count(t, F.lit("!"))).alias("n_exclaims"),
    )
    m = m.withColumn(
        "_tri",
        F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (x, i) -> xxhash64(x, _w[i + 1], _w[i + 2]))"),
    )
    # most texts repeat no window; only the others sort places
    m = m.withColumn(
        "_at",
        F.expr(
            "CASE WHEN size(array_distinct(_tri)) < size(_tri)"
            " THEN sort_array(transform(_tri, (x, i) -> struct(x AS h, i AS p)))"
            " ELSE cast(array() AS array<struct<h: bigint, p: int>>) END"
        ),
    )
    m = m.withColumn(
        "_again",
        F.expr(
            "sort_array(transform(filter(_at, (s, i) -> (i > 0 AND s.h = _at[greatest(i - 1, 0)].h)"
            " OR (i + 1 < size(_at) AND s.h = _at[least(i + 1, size(_at) - 1)].h)), s -> s.p))"
        ),
    )
    return m.select(
        *keep,
        _long(F.size("_w")).alias("n_words"),
        "word_chars",
        "n_symbols",
        _long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.expr(
            "aggregate(_again, struct(-3 AS last, 0L AS n),"
            " (a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n), a -> a.n)"
        ).alias("n_repeat_words"),
        _long(F.size("_lines")).alias("n_lines"),
        "n_upper",
        "n_exclaims",
    )


def ledger(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`measure` plus failure_bits, a long with bit i set where RULES[i] fails."""
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(df, text, keep).withColumn("failure_bits", bits)


def passes(policy: str = DEFAULT_POLICY) -> Column:
    """True where a ledger's row passes the policy."""
    return F.col("failure_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, documents that only it rejects, and those kept without it.

    The ledger is first counted per bit pattern (at most 2 ** len(RULES) rows), then combined with each rule's bit.
    """
    wanted = POLICIES[policy]
    patterns = rows.groupBy(F.col("failure_bits").bitwiseAND(F.lit(wanted).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    out = None
    for i, (name, _) in enumerate(RULES):
        if not wanted >> i & 1:
            continue
        bit, rest = F.lit(1 << i).cast("long"), F.lit(wanted & ~(1 << i)).cast("long")
        one = patterns.agg(
            F.lit(name).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("b").bitwiseAND(bit) != 0, F.col("n"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(F.col("b") == bit, F.col("n"))), F.lit(0)).alias("failed_alone"),
            F.coalesce(F.sum(F.when(F.col("b").bitwiseAND(rest) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failure_bits").bitwiseAND(F.lit(POLICIES["base-1"]).cast("long")) != 0).alias("base_failed"),
        passes().alias("kept"),
        "n_lines", "n_upper", "n_exclaims", "failure_bits",
    )


def _oracle() -> str:
    bits = " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, (_, fails) in enumerate(RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM d),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM w),
trig AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS c FROM tri),
covered AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM trig, (VALUES (0), (1), (2)) AS k(o) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(t, '[{SPACE}]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines,
             length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper,
             length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaims
      FROM w LEFT JOIN covered USING (doc_id)),
l AS (SELECT *, ({bits})::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failure_bits & {POLICIES['base-1']}) <> 0 AS base_failed, (failure_bits & {POLICIES[DEFAULT_POLICY]}) = 0 AS kept,
       n_lines, n_upper, n_exclaims, failure_bits
FROM l"""


OP1_SQL = _oracle()
