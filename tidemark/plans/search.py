"""Search documents and their ranking; adapters, comparisons and verdicts over runs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import PUBLIC_SQL, Domain, public_posts
from .events import _prefixed, fingerprint
from .content import nearest_rank
from .registry import query

_TERMS = "list_filter(list_distinct(regexp_split_to_array(lower({0}), '[^a-z0-9]+')), lambda x: x <> '')"
_DOCS = f"""docs AS (SELECT post_id, {_TERMS.format('title')} AS title_terms, {_TERMS.format("brand || ' ' || theme || ' ' || author_name")} AS body_terms, published_at, title, brand, theme FROM ({PUBLIC_SQL}))"""
QUERY = ("red", "brand", "5", "economy", "small")


def search_docs(d: Domain) -> DataFrame:
    return public_posts(d.posts, d.members).select(
        "post_id", text.terms(F.col("title")).alias("title_terms"), text.terms(F.concat_ws(" ", "brand", "theme", "author_name")).alias("body_terms"), "published_at", "title", "brand", "theme"
    )


@query(
    "search_documents",
    f"WITH {_DOCS} SELECT post_id, list_sort(title_terms)::VARCHAR AS title_terms, len(body_terms)::INTEGER AS body_size, {_prefixed('post_id', 'title', 'brand', 'theme')} AS print FROM docs",
    ("members", "posts"),
)
def search_documents(d: Domain) -> DataFrame:
    """The projection of eligible posts with the fingerprint of what it was made from."""
    shown = F.concat(F.lit("["), F.array_join(F.array_sort("title_terms"), ", "), F.lit("]"))
    return search_docs(d).select("post_id", shown.alias("title_terms"), F.size("body_terms").alias("body_size"), fingerprint("post_id", "title", "brand", "theme").alias("print"))


_HITS = f"""{_DOCS}, hits AS (SELECT post_id, published_at, 2 * len(list_intersect(title_terms, {list(QUERY)})) + len(list_intersect(body_terms, {list(QUERY)})) AS score FROM docs
    WHERE list_has_any(title_terms, {list(QUERY)}) OR list_has_any(body_terms, {list(QUERY)}))"""


def search_hits(d: Domain, words: tuple[str, ...] = QUERY) -> DataFrame:
    """A title term counts 2, a body term 1."""
    wanted = F.array(*map(F.lit, words))
    rows = search_docs(d).filter(F.arrays_overlap("title_terms", wanted) | F.arrays_overlap("body_terms", wanted))
    score = 2 * F.size(F.array_intersect("title_terms", wanted)) + F.size(F.array_intersect("body_terms", wanted))
    return rows.select("post_id", "published_at", score.cast("long").alias("score"))


@query("search_by_terms", f"WITH {_HITS} SELECT post_id, score::BIGINT AS score FROM hits ORDER BY score DESC, published_at DESC NULLS LAST, post_id LIMIT 50", ("members", "posts"))
def search_by_terms(d: Domain) -> DataFrame:
    return search_hits(d).orderBy(F.desc("score"), F.desc_nulls_last("published_at"), "post_id").limit(50).select("post_id", "score")


@query("search_by_recency", f"WITH {_HITS} SELECT post_id, published_at FROM hits ORDER BY published_at DESC NULLS LAST, post_id LIMIT 50", ("members", "posts"))
def search_by_recency(d: Domain) -> DataFrame:
    return search_hits(d).orderBy(F.desc_nulls_last("published_at"), "post_id").limit(50).select("post_id", "published_at")


@query(
    "search_order_differences",
    f"""WITH {_HITS}, a AS (SELECT post_id, row_number() OVER (ORDER BY score DESC, published_at DESC NULLS LAST, post_id) AS ra FROM hits), b AS (SELECT post_id, row_number() OVER (ORDER BY published_at DESC NULLS LAST, post_id) AS rb FROM hits),
    ta AS (SELECT * FROM a WHERE ra <= 50), tb AS (SELECT * FROM b WHERE rb <= 50)
    SELECT coalesce(ta.post_id, tb.post_id) AS post_id, ra::INTEGER AS ra, rb::INTEGER AS rb, CASE WHEN rb IS NULL THEN 'ONLY_FIRST' WHEN ra IS NULL THEN 'ONLY_SECOND' WHEN ra = rb THEN 'SAME' ELSE 'MOVED' END AS verdict FROM ta FULL JOIN tb ON ta.post_id = tb.post_id""",
    ("members", "posts"),
)
def search_order_differences(d: Domain, k: int = 50) -> DataFrame:
    """The first k by score against the first k by recency; only those k rows are numbered."""
    hits = search_hits(d)
    by_score = hits.orderBy(F.desc("score"), F.desc_nulls_last("published_at"), "post_id").limit(k)
    by_time = hits.orderBy(F.desc_nulls_last("published_at"), "post_id").limit(k)
    a = by_score.select("post_id", F.row_number().over(Window.orderBy(F.desc("score"), F.desc_nulls_last("published_at"), "post_id")).alias("ra"))
    b = by_time.select("post_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("published_at"), "post_id")).alias("rb"))
    verdict = F.when(F.col("rb").isNull(), "ONLY_FIRST").when(F.col("ra").isNull(), "ONLY_SECOND").when(F.col("ra") == F.col("rb"), "SAME").otherwise("MOVED")
    return a.join(b, "post_id", "full").select("post_id", "ra", "rb", verdict.alias("verdict"))


#: Wire names of kinds; `report` isn't part of the contract.
WIRES = {"view": "content.viewed", "click": "content.clicked", "save": "content.saved", "follow": "author.followed"}


@query(
    "event_adapter",
    f"""SELECT event_id, CASE WHEN kind = 'report' THEN 'UNSUPPORTED_KIND' WHEN user_id IS NULL THEN 'MISSING_ACTOR' WHEN post_id IS NULL THEN 'MISSING_ENTITY' WHEN value > 300 THEN 'VALUE_OUT_OF_RANGE' ELSE 'ADAPTED' END AS status,
    CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in WIRES.items())} END AS wire FROM behaviour""",
    ("behaviour",),
)
def event_adapter(d: Domain) -> DataFrame:
    """Kinds to wire names, and the first failure that holds."""
    wire = F.create_map(*(F.lit(x) for kv in WIRES.items() for x in kv))[F.col("kind")]
    status = (
        F.when(wire.isNull(), "UNSUPPORTED_KIND").when(F.col("user_id").isNull(), "MISSING_ACTOR").when(F.col("post_id").isNull(), "MISSING_ENTITY")
        .when(F.col("value") > 300, "VALUE_OUT_OF_RANGE").otherwise("ADAPTED")
    )
    return d.behaviour.select("event_id", status.alias("status"), wire.alias("wire"))


@query(
    "canary_readiness",
    """WITH s AS (SELECT post_id % 10 AS service, count(*) AS runs, quantile_disc(value, 0.95) AS p95, count(*) FILTER (WHERE kind = 'report') AS failures FROM behaviour GROUP BY 1)
    SELECT service, runs, p95, CASE WHEN runs < 20 THEN 'TOO_FEW_RUNS' WHEN failures * 4 > runs THEN 'FAILURES' WHEN p95 > 150 THEN 'TOO_SLOW' ELSE 'READY' END AS verdict FROM s""",
    ("behaviour",),
)
def canary_readiness(d: Domain) -> DataFrame:
    b = d.behaviour.select((F.col("post_id") % 10).alias("service"), "value", "kind")
    rows = b.groupBy("service").agg(F.count("*").alias("runs"), F.count_if(F.col("kind") == "report").alias("failures"))
    rows = rows.join(F.broadcast(nearest_rank(b, "service", "value", 0.95, "p95").drop("n")), "service")
    verdict = F.when(F.col("runs") < 20, "TOO_FEW_RUNS").when(F.col("failures") * 4 > F.col("runs"), "FAILURES").when(F.col("p95") > 150, "TOO_SLOW").otherwise("READY")
    return rows.select("service", "runs", "p95", verdict.alias("verdict"))


@query(
    "compatibility_verdict",
    """WITH c AS (SELECT user_id, count(*) FILTER (WHERE value > 300) AS broken, count(*) FILTER (WHERE value > 200) AS unsure, count(*) FILTER (WHERE value > 100) AS conditional, count(*) AS checks FROM behaviour GROUP BY user_id)
    SELECT user_id, checks, CASE WHEN broken > 0 THEN 'INCOMPATIBLE' WHEN unsure > 0 THEN 'INCONCLUSIVE' WHEN conditional > 0 THEN 'CONDITIONALLY_COMPATIBLE' ELSE 'COMPATIBLE' END AS verdict FROM c""",
    ("behaviour",),
)
def compatibility_verdict(d: Domain) -> DataFrame:
    """The worst check decides."""
    over = lambda x: F.count_if(F.col("value") > x)
    rows = d.behaviour.groupBy("user_id").agg(over(300).alias("broken"), over(200).alias("unsure"), over(100).alias("conditional"), F.count("*").alias("checks"))
    verdict = F.when(F.col("broken") > 0, "INCOMPATIBLE").when(F.col("unsure") > 0, "INCONCLUSIVE").when(F.col("conditional") > 0, "CONDITIONALLY_COMPATIBLE").otherwise("COMPATIBLE")
    return rows.select("user_id", "checks", verdict.alias("verdict"))


@query("forbidden_keys", "SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS found FROM events")
def forbidden_keys(d: Domain) -> DataFrame:
    """Events whose properties hold a forbidden key at any depth."""
    return d.table("events").select("event_id", text.contains_key(F.col("props"), "k", "password").alias("found"))


@query("canonical_properties", "SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS props FROM events")
def canonical_properties(d: Domain) -> DataFrame:
    return d.table("events").select("event_id", text.canonical_json(F.col("props")).alias("props"))
