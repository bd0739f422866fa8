"""Search against its predecessor: whether a document may be shown at all, and how two orders of one result differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import NOW, Domain
from .registry import query

# Reasons that deny a document, in order, with their conditions.
DENIALS = (
    ("source_missing", "source is null"), ("visibility_not_public", "not (visibility <=> 'PUBLIC')"), ("publication_not_published", "not (publication <=> 'PUBLISHED')"), ("moderation_not_eligible", "not (moderation <=> 'ELIGIBLE')"),
    ("source_deleted", "not (deletion <=> 'ACTIVE')"), ("operationally_excluded", "excluded"), ("region_missing", "region_id is null or region_ref is null"),
    ("content_invalid", r"title is null or body is null or title rlike '^\\s*\\z' or body rlike '^\\s*\\z'"), ("authority_time_invalid", "updated_at > at + interval 5 seconds"), ("authority_stale", "updated_at < at - max_age"),
)
# End of the fixed values.


def deny(documents: DataFrame, at: str = NOW, max_age_days: int = 30) -> DataFrame:
    """Adds decision: the first reason that denies the document, else "eligible". max_age_days: 1 to 30.

    documents: source (null: there is none), visibility, publication, moderation, deletion, excluded, region_id, region_ref, title, body, updated_at."""
    if not 1 <= max_age_days <= 30:
        raise ValueError("max_age_days must be 1 to 30")
    timed = documents.withColumns({"at": F.lit(at).cast("timestamp"), "max_age": F.make_dt_interval(F.lit(max_age_days))})
    return timed.withColumn("decision", F.coalesce(*(F.when(F.expr(c), reason) for reason, c in DENIALS), F.lit("eligible"))).drop("at", "max_age")


def compare_orders(first: DataFrame, second: DataFrame, by: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """(measures, mismatches) of two orders per case. first, second: (*by, position from 1, ref); a ref may come more than once.

    measures: counts, refs in both and in one only, those within the first k of both and their share, the length of the common beginning, repeats.
    mismatches: code, ref and its first positions; ref is null where the case as a whole differs. A case may be in one of the two only.
    Two groupings of the same rows, by ref and by position; nothing is a list, so orders can be of any length."""
    sides = [t.select(*by, "position", "ref", F.lit(s).alias("side")) for s, t in enumerate((first, second))]
    both = sides[0].unionByName(sides[1])
    of = lambda s, c: F.when(F.col("side") == s, F.col(c))
    refs = both.groupBy(*by, "ref").agg(F.min(of(0, "position")).alias("a"), F.min(of(1, "position")).alias("b"), F.count(of(0, "position")).alias("na"), F.count(of(1, "position")).alias("nb"))
    places = both.groupBy(*by, "position").agg(F.min(of(0, "ref")).alias("x"), F.min(of(1, "ref")).alias("y"))
    begun = places.groupBy(*by).agg(F.coalesce(F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("position"))) - 1, F.max("position")).alias("same_prefix"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("_differ"))
    shared = F.col("a").isNotNull() & F.col("b").isNotNull()
    counted = refs.groupBy(*by).agg(
        F.sum("na").alias("n_first"), F.sum("nb").alias("n_second"), F.count_if(shared).alias("n_both"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"),
        F.count_if((F.col("a") <= k) & (F.col("b") <= k)).alias("top_overlap"), F.sum(F.greatest(F.col("na") - 1, F.lit(0)) + F.greatest(F.col("nb") - 1, F.lit(0))).alias("repeats"),
    )
    joined = counted.join(begun, by).withColumn("top_share", F.col("top_overlap") / F.least(F.lit(k), F.greatest("n_first", "n_second")))
    same_set = (F.col("only_first") == 0) & (F.col("only_second") == 0)
    codes = F.array(
        F.when(F.col("repeats") > 0, "DUPLICATE_ENTITY"), F.when(F.col("n_first") != F.col("n_second"), "COUNT_MISMATCH"), F.when(~same_set, "ENTITY_SET_MISMATCH"), F.when(same_set & (F.col("_differ") > 0), "ORDERING_MISMATCH")
    )
    whole = joined.select(*by, F.explode(F.array_compact(codes)).alias("code"), F.lit(None).cast(first.schema["ref"].dataType).alias("ref"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))
    code = F.when(F.col("b").isNull(), "MISSING_ENTITY").when(F.col("a").isNull(), "UNEXPECTED_ENTITY").when(F.col("a") != F.col("b"), "POSITION_MISMATCH")
    each = refs.withColumn("code", code).filter("code is not null").select(*by, "code", "ref", "a", "b")
    return joined.drop("_differ"), whole.unionByName(each)


_DOCUMENT = {
    "source": "CASE WHEN post_id % 31 <> 0 THEN post_id END", "moderation": "CASE WHEN hidden THEN 'HELD' ELSE 'ELIGIBLE' END", "deletion": "CASE WHEN post_id % 17 = 0 THEN 'DELETED' ELSE 'ACTIVE' END",
    "excluded": "post_id % 19 = 0", "region_ref": "CASE WHEN post_id % 13 <> 0 THEN concat('region:', region_id) END", "body": "CASE WHEN post_id % 23 = 0 THEN '  ' ELSE theme END",
    "updated_at": f"CASE WHEN post_id % 29 = 0 THEN TIMESTAMP '{NOW}' + INTERVAL 6 SECOND WHEN post_id % 27 = 0 THEN TIMESTAMP '{NOW}' + INTERVAL 5 SECOND ELSE coalesce(published_at, TIMESTAMP '{NOW}') END",
}


@query(
    "document_eligibility",
    f"""WITH s AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _DOCUMENT.items())} FROM posts)
    SELECT post_id, CASE WHEN source IS NULL THEN 'source_missing' WHEN visibility <> 'PUBLIC' THEN 'visibility_not_public' WHEN status <> 'PUBLISHED' THEN 'publication_not_published' WHEN moderation <> 'ELIGIBLE' THEN 'moderation_not_eligible'
    WHEN deletion <> 'ACTIVE' THEN 'source_deleted' WHEN excluded THEN 'operationally_excluded' WHEN region_ref IS NULL THEN 'region_missing' WHEN trim(body) = '' OR trim(title) = '' THEN 'content_invalid'
    WHEN updated_at > TIMESTAMP '{NOW}' + INTERVAL 5 SECOND THEN 'authority_time_invalid' WHEN updated_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN 'authority_stale' ELSE 'eligible' END AS decision FROM s""",
    ("posts",),
)
def document_eligibility(d: Domain) -> DataFrame:
    """Posts as search documents, each with the first reason that denies it."""
    return deny(d.posts.withColumns({k: F.expr(v) for k, v in _DOCUMENT.items()}).withColumnRenamed("status", "publication")).select("post_id", "decision")


def run_orders(d: Domain) -> tuple[DataFrame, DataFrame]:
    """A run's posts in their order, and, but for every third run, by quantity and without some that were returned."""
    rows = d.runs.select("run_id", "rank", "quantity", "flag", "post_id", F.concat(F.lit("post:"), (F.col("post_id") % 40).cast("string")).alias("ref"))
    w = Window.partitionBy("run_id").orderBy(F.when(F.col("run_id") % 3 != 0, -F.col("quantity")), "rank")
    kept = rows.filter("not (flag = 'R' and post_id % 5 = 0)").withColumn("position", F.row_number().over(w))
    return rows.select("run_id", F.col("rank").cast("int").alias("position"), "ref"), kept.select("run_id", "position", "ref")


_ORDERS = """WITH a AS (SELECT run_id, rank::INTEGER AS position, 'post:' || (post_id % 40) AS ref FROM runs),
    b AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN run_id % 3 <> 0 THEN -quantity END, rank)::INTEGER AS position, 'post:' || (post_id % 40) AS ref FROM runs WHERE NOT (flag = 'R' AND post_id % 5 = 0)),
    fa AS (SELECT run_id, ref, min(position) AS a, count(*) AS na FROM a GROUP BY ALL), fb AS (SELECT run_id, ref, min(position) AS b, count(*) AS nb FROM b GROUP BY ALL),
    e AS (SELECT run_id, ref, a, b, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM fa FULL JOIN fb USING (run_id, ref)),
    p AS (SELECT run_id, position, a.ref AS x, b.ref AS y FROM a FULL JOIN b USING (run_id, position)),
    q AS (SELECT run_id, coalesce(min(position) FILTER (WHERE x IS DISTINCT FROM y) - 1, max(position)) AS same_prefix, count(*) FILTER (WHERE x IS DISTINCT FROM y) AS differ FROM p GROUP BY run_id),
    m AS (SELECT run_id, sum(na)::BIGINT AS n_first, sum(nb)::BIGINT AS n_second, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (WHERE b IS NULL) AS only_first, count(*) FILTER (WHERE a IS NULL) AS only_second,
        count(*) FILTER (WHERE a <= 3 AND b <= 3) AS top_overlap, sum(greatest(na - 1, 0) + greatest(nb - 1, 0))::BIGINT AS repeats FROM e GROUP BY run_id),
    j AS (SELECT *, top_overlap / least(3, greatest(n_first, n_second)) AS top_share FROM m JOIN q USING (run_id))"""


@query("order_measures", f"{_ORDERS} SELECT * EXCLUDE (differ) FROM j", ("runs",))
def order_measures(d: Domain) -> DataFrame:
    """Per run, how its two orders agree."""
    return compare_orders(*run_orders(d), ["run_id"], 3)[0]


@query(
    "order_mismatches",
    f"""{_ORDERS}, w AS (SELECT run_id, unnest([CASE WHEN repeats > 0 THEN 'DUPLICATE_ENTITY' END, CASE WHEN n_first <> n_second THEN 'COUNT_MISMATCH' END, CASE WHEN only_first + only_second > 0 THEN 'ENTITY_SET_MISMATCH' END,
        CASE WHEN only_first + only_second = 0 AND differ > 0 THEN 'ORDERING_MISMATCH' END]) AS code FROM j)
    SELECT run_id, code, NULL::VARCHAR AS ref, NULL::INTEGER AS a, NULL::INTEGER AS b FROM w WHERE code IS NOT NULL
    UNION ALL SELECT run_id, CASE WHEN b IS NULL THEN 'MISSING_ENTITY' WHEN a IS NULL THEN 'UNEXPECTED_ENTITY' ELSE 'POSITION_MISMATCH' END, ref, a, b FROM e WHERE a IS NULL OR b IS NULL OR a <> b""",
    ("runs",),
)
def order_mismatches(d: Domain) -> DataFrame:
    """What differs between a run's two orders, by kind."""
    return compare_orders(*run_orders(d), ["run_id"], 3)[1]
