"""Scores, rankings and exploration over posts as candidates."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, scoring, vocabulary
from ..operators.ranking import ranked
from ..sources.tables import NOW, Domain, now
from .registry import query

#: Per post: counts of behaviour, as SQL.
_COUNTS = """c AS (SELECT post_id, count(*) FILTER (WHERE kind = 'view') AS views, count(*) FILTER (WHERE kind = 'click') AS likes, count(*) FILTER (WHERE kind = 'save') AS saves,
    count(*) FILTER (WHERE kind = 'follow') AS shares FROM behaviour GROUP BY post_id)"""
_AGE = f"(epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(published_at)) / 86400000.0"

#: Types in rank order; the first two have all four components, the others only the anchors, whose weights then make up the whole.
TYPES = ("POST", "JOURNEY", "PLACE", "CREW")
_TYPE = "(['POST', 'JOURNEY', 'PLACE', 'CREW', 'REGION'])[1 + post_id % 5]"


def type_of(post_id: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, (*TYPES, "REGION"))), (1 + post_id % 5).cast("int"))


def counts(d: Domain) -> DataFrame:
    kinds = {"views": "view", "likes": "click", "saves": "save", "shares": "follow"}
    return d.behaviour.groupBy("post_id").agg(*(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()))


@query("freshness", f"SELECT post_id, round(pow(2.0, -({_AGE}) / 14.0), 9) AS fresh, round(pow(2.0, -({_AGE}) / 30.0), 9) AS fresh_slow FROM posts WHERE published_at IS NOT NULL", ("posts",))
def freshness(d: Domain) -> DataFrame:
    days = scoring.age_days(F.col("published_at"), now())
    return d.posts.filter("published_at is not null").select("post_id", F.round(scoring.freshness(days, scoring.HALF_LIFE_DAYS["post"]), 9).alias("fresh"), F.round(scoring.freshness(days, scoring.HALF_LIFE_DAYS["slow"]), 9).alias("fresh_slow"))


def _wilson_sql(k: str) -> str:
    z = scoring.WILSON_Z
    return f"(({k}::DOUBLE / n) + {z * z} / (2 * n) - {z} * sqrt((({k}::DOUBLE / n) * (1 - {k}::DOUBLE / n) + {z * z} / (4 * n)) / n)) / (1 + {z * z} / n)"


@query(
    "engagement",
    f"""WITH b AS (SELECT *, {_TYPE} AS type FROM behaviour), c AS (SELECT post_id, type, count(*) AS exposure, count(*) FILTER (WHERE kind = 'click') AS likes, count(*) FILTER (WHERE kind = 'save') AS saves, count(*) FILTER (WHERE kind = 'follow') AS shares
        FROM b WHERE ts >= TIMESTAMP '{NOW}' - to_days(CASE type WHEN 'POST' THEN 14 WHEN 'JOURNEY' THEN 30 END) AND ts < TIMESTAMP '{NOW}' GROUP BY 1, 2), e AS (SELECT *, exposure::DOUBLE AS n FROM c)
    SELECT post_id, type, exposure, CASE WHEN n >= 20 THEN round((0.25 * {_wilson_sql('likes')} + 0.5 * {_wilson_sql('saves')} + 0.25 * {_wilson_sql('shares')}) * (0.75 + 0.25 * least(1.0, ln(1 + n) / CASE type WHEN 'POST' THEN ln(501.0) ELSE ln(201.0) END)), 9) END AS score FROM e""",
    ("behaviour",),
)
def engagement(d: Domain) -> DataFrame:
    """Of the types that have engagement; every behaviour within the type's days is an exposure, so that no rate is above one."""
    rows = d.behaviour.withColumn("type", type_of(F.col("post_id")))
    since = now() - F.make_dt_interval(days=scoring.by_type(scoring.ENGAGEMENT_DAYS, F.col("type")))
    kinds = {"likes": "click", "saves": "save", "shares": "follow"}
    rows = rows.filter((F.col("ts") >= since) & (F.col("ts") < now())).groupBy("post_id", "type").agg(F.count("*").alias("exposure"), *(F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()))
    return rows.select("post_id", "type", "exposure", F.round(scoring.engagement(F.col("exposure"), {k: F.col(k) for k in scoring.ENGAGEMENT_WEIGHTS}, F.col("type")), 9).alias("score"))


_PREFER = """prefs AS (SELECT user_id, post_id % 6 AS feature, kind = 'report' AS avoided, (['explicit', 'admin', 'system', 'behavior', 'ai'])[1 + event_id % 5] AS source, (event_id % 11) / 10.0 AS weight, event_id FROM behaviour WHERE kind IN ('save', 'report')),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, feature ORDER BY list_position(['explicit', 'admin', 'system', 'behavior', 'ai'], source), event_id DESC) AS n FROM prefs WHERE weight > 0),
    top AS (SELECT * FROM ranked WHERE n = 1)"""
SOURCES = ("explicit", "admin", "system", "behavior", "ai")


def preferences(d: Domain) -> DataFrame:
    """One preference per member and feature: that of the highest source, then the newest; a minimum per key, folded early."""
    rows = d.behaviour.filter("kind in ('save', 'report')").select(
        "user_id", (F.col("post_id") % 6).alias("feature"), (F.col("kind") == "report").alias("avoided"), (F.col("event_id") % 5).cast("int").alias("place"),
        ((F.col("event_id") % 11) / 10.0).alias("weight"), "event_id",
    ).filter("weight > 0")
    best = rows.groupBy("user_id", "feature").agg(F.min(F.struct("place", -F.col("event_id"), "avoided", "weight")).alias("p"))
    return best.select("user_id", "feature", F.col("p.avoided").alias("avoided"), F.element_at(F.array(*map(F.lit, SOURCES)), F.col("p.place") + 1).alias("source"), F.col("p.weight").alias("weight"))


@query("source_priority", f"WITH {_PREFER} SELECT user_id, feature, avoided, source, round(weight, 6) AS weight FROM top", ("behaviour",))
def source_priority(d: Domain) -> DataFrame:
    return preferences(d).withColumn("weight", F.round("weight", 6))


#: Features of posts: up to three, from several sources, not all of them accepted. Interest drops what can't count before it picks
#: a feature's source; context picks the source first.
_FEATURES = """feats AS (SELECT post_id, (post_id + k * (1 + post_id % 5)) % 6 AS feature, (post_id + k) % 5 AS place, ((post_id * 7 + k * 3) % 11) / 10.0 AS weight, (post_id + k) % 9 <> 0 AS accepted FROM posts, (VALUES (0), (1), (2)) v(k)),
    liked AS (SELECT post_id, feature, arg_min(weight, place) AS w FROM feats WHERE accepted AND weight > 0 GROUP BY 1, 2),
    fit AS (SELECT post_id, feature, arg_min(weight, place) AS w, min(place) AS place FROM feats WHERE accepted GROUP BY 1, 2),
    seen AS (SELECT DISTINCT user_id, post_id FROM behaviour WHERE kind = 'view')"""


def post_features(d: Domain) -> DataFrame:
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    return d.posts.select("post_id", k).select(
        "post_id", ((F.col("post_id") + F.col("k") * (1 + F.col("post_id") % 5)) % 6).alias("feature"), ((F.col("post_id") + F.col("k")) % 5).alias("place"),
        ((F.col("post_id") * 7 + F.col("k") * 3) % 11 / 10.0).alias("weight"), ((F.col("post_id") + F.col("k")) % 9 != 0).alias("accepted"),
    )


def _first_source(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("post_id", "feature").agg(F.min(F.struct("place", "weight")).alias("b"))
    return best.select("post_id", "feature", F.col("b.weight").alias("w"), F.col("b.place").alias("place"))


def seen_pairs(d: Domain) -> DataFrame:
    return d.behaviour.filter("kind = 'view'").select("user_id", "post_id").distinct()


_INTEREST = """known AS (SELECT DISTINCT user_id FROM top),
    im AS (SELECT s.user_id, s.post_id, sum(l.w) AS total, coalesce(sum(CASE WHEN NOT avoided THEN l.w * t.weight END), 0) AS p, coalesce(sum(CASE WHEN avoided THEN l.w * t.weight END), 0) AS n,
        coalesce(bool_or(avoided AND source = 'explicit' AND l.w * t.weight + 1e-12 >= 0.8), false) AS hard, bool_or(k.user_id IS NOT NULL) AS signals
        FROM seen s LEFT JOIN liked l USING (post_id) LEFT JOIN top t ON t.user_id = s.user_id AND t.feature = l.feature LEFT JOIN known k ON k.user_id = s.user_id GROUP BY 1, 2),
    interest AS (SELECT user_id, post_id, CASE WHEN total IS NULL OR NOT signals THEN 'NOT_APPLICABLE' WHEN hard THEN 'HARD_EXCLUDED' ELSE 'SCORED' END AS status,
        CASE WHEN total IS NULL OR NOT signals THEN NULL WHEN hard THEN 0.0 ELSE least(1.0, greatest(0.0, p / total - n / total)) END AS score FROM im)"""


def interest(d: Domain) -> DataFrame:
    """(user_id, post_id, status, score) of seen posts: weighted preferred minus avoided share of all the post's feature weights."""
    liked = _first_source(post_features(d).filter("accepted and weight > 0"))
    likes = preferences(d)
    rows = seen_pairs(d).join(liked, "post_id", "left").join(likes, ["user_id", "feature"], "left").join(likes.select("user_id", F.lit(True).alias("known")).distinct(), "user_id", "left")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("w") * F.col("weight"))), F.lit(0.0))
    hard = F.col("avoided") & (F.col("source") == "explicit") & (F.col("w") * F.col("weight") + 1e-12 >= 0.8)
    rows = rows.groupBy("user_id", "post_id").agg(
        F.sum("w").alias("total"), part(~F.col("avoided")).alias("p"), part(F.col("avoided")).alias("n"), F.coalesce(F.bool_or(hard), F.lit(False)).alias("hard"), F.max("known").alias("known")
    )
    none = F.col("total").isNull() | F.col("known").isNull()
    status = F.when(none, "NOT_APPLICABLE").when(F.col("hard"), "HARD_EXCLUDED").otherwise("SCORED")
    score = F.when(none, F.lit(None)).when(F.col("hard"), 0.0).otherwise(scoring.clamp(F.col("p") / F.col("total") - F.col("n") / F.col("total")))
    return rows.select("user_id", "post_id", status.alias("status"), score.alias("score"))


@query("interest_match", f"WITH {_PREFER}, {_FEATURES}, {_INTEREST} SELECT user_id, post_id, status, round(score, 9) + 0.0 AS score FROM interest", ("behaviour", "posts"))
def interest_match(d: Domain) -> DataFrame:
    return interest(d).withColumn("score", F.round("score", 9))


#: A member's clauses, folded: equal clauses add their strengths, and there are no more of them than the vocabulary gives.
_CLAUSES = """cl AS (SELECT user_id, post_id % 6 AS f1, post_id % 7 AS f2, kind = 'save' AS preferred, event_id % 2 = 0 AS every, event_id % 61 = 0 AS hard, event_id % 13 <> 0 AS accepted, sum((event_id % 9 + 1) / 10.0) AS strength
        FROM behaviour WHERE kind IN ('save', 'report') GROUP BY ALL),
    met AS (SELECT s.user_id, s.post_id, f1, f2, preferred, every, hard, accepted, strength, max(CASE WHEN f.feature = f1 THEN f.w END) AS w1, max(CASE WHEN f.feature = f2 THEN f.w END) AS w2,
        max(CASE WHEN f.feature = f1 AND f.w >= 0.5 AND f.place <= 2 THEN 1 ELSE 0 END) AS h1, max(CASE WHEN f.feature = f2 AND f.w >= 0.5 AND f.place <= 2 THEN 1 ELSE 0 END) AS h2, count(f.feature) AS observed
        FROM seen s JOIN cl USING (user_id) LEFT JOIN fit f ON f.post_id = s.post_id AND f.w > 0 GROUP BY ALL),
    q AS (SELECT *, CASE WHEN every THEN CASE WHEN w1 IS NOT NULL AND w2 IS NOT NULL THEN (w1 + w2) / 2 ELSE 0.0 END ELSE coalesce(greatest(w1, w2), 0.0) END AS quality,
        CASE WHEN every THEN h1 = 1 AND h2 = 1 ELSE h1 = 1 OR h2 = 1 END AS matched FROM met)"""


def met_clauses(d: Domain) -> DataFrame:
    """Each folded clause of a member beside each post the member saw: match quality (any: largest weight, every: mean) and hard match.

    Members meet their own posts only, and a member's clauses are as many as the vocabulary gives at most.
    """
    clauses = (
        d.behaviour.filter("kind in ('save', 'report')")
        .select(
            "user_id", (F.col("post_id") % 6).alias("f1"), (F.col("post_id") % 7).alias("f2"), (F.col("kind") == "save").alias("preferred"), (F.col("event_id") % 2 == 0).alias("every"),
            (F.col("event_id") % 61 == 0).alias("hard"), (F.col("event_id") % 13 != 0).alias("accepted"), ((F.col("event_id") % 9 + 1) / 10.0).alias("strength"),
        )
        .groupBy("user_id", "f1", "f2", "preferred", "every", "hard", "accepted").agg(F.sum("strength").alias("strength"))
    )
    fit = _first_source(post_features(d).filter("accepted")).filter("w > 0").groupBy("post_id").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("w", (((F.col("w") >= 0.5) & (F.col("place") <= 2))).alias("hard"))))).alias("have")
    )
    rows = seen_pairs(d).join(fit, "post_id", "left").join(clauses, "user_id")
    of = lambda c: F.col("have")[F.col(c)]
    w1, w2, h1, h2 = of("f1")["w"], of("f2")["w"], F.coalesce(of("f1")["hard"], F.lit(False)), F.coalesce(of("f2")["hard"], F.lit(False))
    mean = F.when(w1.isNotNull() & w2.isNotNull(), (w1 + w2) / 2).otherwise(0.0)
    return rows.select(
        "user_id", "post_id", "preferred", "hard", "accepted", "strength", F.coalesce(F.size("have"), F.lit(0)).alias("observed"),
        F.when(F.col("every"), mean).otherwise(F.coalesce(F.greatest(w1, w2), F.lit(0.0))).alias("quality"), F.when(F.col("every"), h1 & h2).otherwise(h1 | h2).alias("matched"),
    )


_CONTEXT = """soft AS (SELECT user_id, post_id, sum(strength) FILTER (WHERE preferred) AS p, coalesce(sum(strength * quality) FILTER (WHERE preferred), 0) AS ph, sum(strength) FILTER (WHERE NOT preferred) AS v,
        coalesce(sum(strength * quality) FILTER (WHERE NOT preferred), 0) AS vh FROM q WHERE accepted AND NOT hard AND observed > 0 GROUP BY 1, 2),
    context AS (SELECT user_id, post_id, least(1.0, greatest(0.0, CASE WHEN p IS NULL THEN 1.0 ELSE ph / p END - CASE WHEN v IS NULL THEN 0.0 ELSE vh / v END)) AS score FROM soft)"""


def context_scores(met: DataFrame) -> DataFrame:
    """Covered preferred strength minus covered avoided strength, of accepted soft clauses about features the post has."""
    of = lambda yes, c: F.sum(F.when(F.col("preferred") == yes, c))
    rows = met.filter("accepted and not hard and observed > 0").groupBy("user_id", "post_id").agg(
        of(True, F.col("strength")).alias("p"), of(True, F.col("strength") * F.col("quality")).alias("ph"), of(False, F.col("strength")).alias("v"), of(False, F.col("strength") * F.col("quality")).alias("vh")
    )
    return rows.select("user_id", "post_id", scoring.clamp(F.coalesce(F.col("ph") / F.col("p"), F.lit(1.0)) - F.coalesce(F.col("vh") / F.col("v"), F.lit(0.0))).alias("score"))


@query("context_match", f"WITH {_FEATURES}, {_CLAUSES}, {_CONTEXT} SELECT user_id, post_id, round(score, 6) + 0.0 AS score FROM context", ("behaviour", "posts"))
def context_match(d: Domain) -> DataFrame:
    return context_scores(met_clauses(d)).withColumn("score", F.round("score", 6))


_ELIGIBLE = """hardly AS (SELECT user_id, post_id, count(*) FILTER (WHERE hard AND accepted) AS clauses, count(*) FILTER (WHERE hard AND accepted AND NOT preferred AND matched) AS excluded, count(*) FILTER (WHERE hard AND accepted AND preferred AND NOT matched) AS missing FROM q GROUP BY 1, 2),
    eligible AS (SELECT user_id, post_id, excluded, missing, CASE WHEN clauses = 0 THEN 'NOT_APPLICABLE' WHEN excluded > 0 OR missing > 0 THEN 'HARD_EXCLUDED' ELSE 'ELIGIBLE' END AS status,
        CASE WHEN clauses = 0 THEN 'NO_HARD_CONTEXT_CLAUSES' WHEN excluded > 0 THEN 'MATCHED_EXCLUDED_CLAUSE' WHEN missing > 0 THEN 'MISSING_REQUIRED_CLAUSE' END AS reason FROM hardly)"""


def eligibility(met: DataFrame) -> DataFrame:
    """Accepted hard clauses: an excluded one that matches excludes, then a required one that doesn't; without any it doesn't apply."""
    hard = F.col("hard") & F.col("accepted")
    rows = met.groupBy("user_id", "post_id").agg(
        F.count_if(hard).alias("clauses"), F.count_if(hard & ~F.col("preferred") & F.col("matched")).alias("excluded"), F.count_if(hard & F.col("preferred") & ~F.col("matched")).alias("missing")
    )
    none, ex, mi = F.col("clauses") == 0, F.col("excluded") > 0, F.col("missing") > 0
    return rows.select(
        "user_id", "post_id", "excluded", "missing", F.when(none, "NOT_APPLICABLE").when(ex | mi, "HARD_EXCLUDED").otherwise("ELIGIBLE").alias("status"),
        F.when(none, "NO_HARD_CONTEXT_CLAUSES").when(ex, "MATCHED_EXCLUDED_CLAUSE").when(mi, "MISSING_REQUIRED_CLAUSE").alias("reason"),
    )


@query("context_eligibility", f"WITH {_FEATURES}, {_CLAUSES}, {_ELIGIBLE} SELECT user_id, post_id, excluded, missing, status, reason FROM eligible", ("behaviour", "posts"))
def context_eligibility(d: Domain) -> DataFrame:
    return eligibility(met_clauses(d))


_SCORED = f"""{_COUNTS}, s AS (SELECT p.post_id, p.theme, p.author_id, p.region_id, p.price, CASE WHEN published_at IS NOT NULL THEN pow(2.0, -({_AGE}) / 14.0) END AS fresh,
    ln(1 + coalesce(views, 0)) + 2 * ln(1 + coalesce(likes, 0)) + 3 * ln(1 + coalesce(saves, 0)) AS pop, coalesce(views, 0) AS views, (p.post_id % 9) / 8.0 AS interest, CASE WHEN p.post_id % 4 <> 0 THEN (p.post_id % 5) / 4.0 END AS context
    FROM posts p LEFT JOIN c USING (post_id) WHERE status = 'PUBLISHED'),
    t AS (SELECT *, CASE WHEN max(pop) OVER (PARTITION BY theme) > 0 THEN pop / max(pop) OVER (PARTITION BY theme) ELSE 0.0 END AS popular FROM s)"""


def scored(d: Domain) -> DataFrame:
    """Published posts with the parts of their score; popularity is relative to the largest of the theme."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = d.posts.filter("status = 'PUBLISHED'").join(counts(d), "post_id", "left").select(
        "post_id", "theme", "author_id", "region_id", "price",
        scoring.age_days(F.col("published_at"), now()).alias("days"), scoring.freshness(scoring.age_days(F.col("published_at"), now()), 14.0).alias("fresh"),
        scoring.raw_popularity(zero("views"), zero("likes"), zero("saves")).alias("pop"), zero("views").alias("views"),
        ((F.col("post_id") % 9) / 8.0).alias("interest"), F.when(F.col("post_id") % 4 != 0, (F.col("post_id") % 5) / 4.0).alias("context"),
    )
    most = rows.groupBy("theme").agg(F.max("pop").alias("most"))
    return rows.join(most, "theme").withColumn("popular", F.when(F.col("most") > 0, F.col("pop") / F.col("most")).otherwise(0.0))


@query("popularity_normalised", f"WITH {_SCORED} SELECT post_id, round(pop, 9) AS pop, round(popular, 9) AS popular FROM t", ("behaviour", "posts"))
def popularity_normalised(d: Domain) -> DataFrame:
    return scored(d).select("post_id", F.round("pop", 9).alias("pop"), F.round("popular", 9).alias("popular"))


_P0 = "0.40 * coalesce(context, 0.5) + 0.35 * interest + 0.15 * coalesce(fresh, 0.5) + 0.10 * popular"


@query(
    "base_ranking",
    f"""WITH {_SCORED}, x AS (SELECT *, round({_P0}, 9) AS score, CASE WHEN context IS NULL THEN 0.40 ELSE 0.0 END + CASE WHEN fresh IS NULL THEN 0.15 ELSE 0.0 END AS neutral FROM t),
    r AS (SELECT theme, post_id, score, round(neutral, 6) AS neutral, row_number() OVER (PARTITION BY theme ORDER BY score DESC, round(neutral, 6), post_id % 5, post_id) AS rank FROM x)
    SELECT theme, post_id, score, neutral, rank::INTEGER AS rank FROM r WHERE rank <= 100""",
    ("behaviour", "posts"),
)
def base_ranking(d: Domain, most: int = 100) -> DataFrame:
    """Composite score, then the smaller neutral-filled weight, then the type, then the id."""
    parts = {"interest": F.col("interest"), "context": F.col("context"), "freshness": F.col("fresh"), "popularity": F.col("popular")}
    neutral = F.lit(0.0)
    for name, c in parts.items():
        neutral = neutral + F.when(c.isNull(), scoring.COMPOSITION[name]).otherwise(0.0)
    rows = scored(d).select("theme", "post_id", F.round(scoring.compose(parts), 9).alias("score"), F.round(neutral, 6).alias("neutral"))
    w = Window.partitionBy("theme").orderBy(F.desc("score"), "neutral", F.col("post_id") % 5, "post_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


_ANCHORS = scoring.COMPOSITION["context"] + scoring.COMPOSITION["interest"]

_CANDIDATES = f"""{_SCORED}, {_PREFER}, {_FEATURES}, {_INTEREST}, {_CLAUSES}, {_CONTEXT}, {_ELIGIBLE},
    cand AS (SELECT s.user_id, s.post_id, {_TYPE.replace("post_id", "s.post_id")} AS type, s.user_id % 23 = 0 AS expired, e.status AS gate, i.status AS liked, i.score AS interest, c.score AS context, t.fresh, t.popular
        FROM seen s LEFT JOIN interest i USING (user_id, post_id) LEFT JOIN context c USING (user_id, post_id) LEFT JOIN eligible e USING (user_id, post_id) LEFT JOIN t ON t.post_id = s.post_id),
    st AS (SELECT *, liked = 'SCORED' OR context IS NOT NULL AS anchored, coalesce(gate = 'HARD_EXCLUDED', false) AS cx, liked = 'HARD_EXCLUDED' AS ix, type IN ('POST', 'JOURNEY') AS timed FROM cand),
    result AS (SELECT user_id, post_id, type, CASE WHEN expired OR type = 'REGION' THEN 'NOT_APPLICABLE' WHEN cx OR ix THEN 'HARD_EXCLUDED' WHEN NOT anchored THEN 'NOT_APPLICABLE' ELSE 'SCORED' END AS status,
        CASE WHEN expired THEN 'EXPIRED_CONTEXT' WHEN type = 'REGION' THEN 'UNSUPPORTED_ENTITY_TYPE' WHEN cx AND ix THEN 'MULTIPLE_HARD_EXCLUSIONS' WHEN cx THEN 'CONTEXT_HARD_EXCLUSION' WHEN ix THEN 'INTEREST_HARD_EXCLUSION' WHEN NOT anchored THEN 'NO_ANCHOR_COMPONENT'
            WHEN liked = 'SCORED' AND context IS NOT NULL THEN 'PERSONALIZED_CONTEXTUAL' WHEN context IS NOT NULL THEN 'CONTEXTUAL_ONLY' ELSE 'INTEREST_ONLY' END AS reason,
        CASE WHEN timed THEN 0.40 * coalesce(context, 0.5) + 0.35 * CASE WHEN liked = 'SCORED' THEN interest ELSE 0.5 END + 0.15 * coalesce(fresh, 0.5) + 0.10 * coalesce(popular, 0.5)
            ELSE 0.40 / 0.75 * coalesce(context, 0.5) + 0.35 / 0.75 * CASE WHEN liked = 'SCORED' THEN interest ELSE 0.5 END END AS raw,
        CASE WHEN context IS NULL THEN CASE WHEN timed THEN 0.40 ELSE 0.40 / 0.75 END ELSE 0.0 END + CASE WHEN liked <> 'SCORED' THEN CASE WHEN timed THEN 0.35 ELSE 0.35 / 0.75 END ELSE 0.0 END + CASE WHEN timed AND fresh IS NULL THEN 0.15 ELSE 0.0 END + CASE WHEN timed AND popular IS NULL THEN 0.10 ELSE 0.0 END AS filled FROM st)"""


def candidates(d: Domain) -> DataFrame:
    """Seen posts with status (expired, unsupported, excluded, without anchor, scored: the first that holds), reason or mode, score, neutral-filled weight.

    A type's weights are those of its components, made to add up to one; what is missing counts NEUTRAL.
    """
    met, pair = met_clauses(d), ["user_id", "post_id"]
    rows = (
        seen_pairs(d)
        .join(interest(d).select(*pair, F.col("status").alias("liked"), F.col("score").alias("interest")), pair, "left")
        .join(context_scores(met).withColumnRenamed("score", "context"), pair, "left")
        .join(eligibility(met).select(*pair, F.col("status").alias("gate")), pair, "left")
        .join(scored(d).select("post_id", "fresh", "popular"), "post_id", "left")
        .withColumn("type", type_of(F.col("post_id")))
    )
    has_interest, has_context = F.col("liked") == "SCORED", F.col("context").isNotNull()
    cx, ix, timed = F.coalesce(F.col("gate") == "HARD_EXCLUDED", F.lit(False)), F.col("liked") == "HARD_EXCLUDED", F.col("type").isin("POST", "JOURNEY")
    expired, unsupported = F.col("user_id") % 23 == 0, F.col("type") == "REGION"
    status = F.when(expired | unsupported, "NOT_APPLICABLE").when(cx | ix, "HARD_EXCLUDED").when(~(has_interest | has_context), "NOT_APPLICABLE").otherwise("SCORED")
    reason = (
        F.when(expired, "EXPIRED_CONTEXT").when(unsupported, "UNSUPPORTED_ENTITY_TYPE").when(cx & ix, "MULTIPLE_HARD_EXCLUSIONS").when(cx, "CONTEXT_HARD_EXCLUSION").when(ix, "INTEREST_HARD_EXCLUSION")
        .when(~(has_interest | has_context), "NO_ANCHOR_COMPONENT").when(has_interest & has_context, "PERSONALIZED_CONTEXTUAL").when(has_context, "CONTEXTUAL_ONLY").otherwise("INTEREST_ONLY")
    )
    parts = {"context": F.col("context"), "interest": F.when(has_interest, F.col("interest")), "freshness": F.col("fresh"), "popularity": F.col("popular")}
    total, filled = F.lit(0.0), F.lit(0.0)
    for name, c in parts.items():
        w = scoring.COMPOSITION[name]
        weight = F.when(timed, w).otherwise(w / _ANCHORS if name in ("context", "interest") else 0.0)
        total, filled = total + weight * F.coalesce(c, F.lit(scoring.NEUTRAL)), filled + F.when(c.isNull(), weight).otherwise(0.0)
    scores = F.when(status == "SCORED", F.round(scoring.clamp(total), 9))
    return rows.select(*pair, "type", status.alias("status"), reason.alias("reason"), scores.alias("score"), F.when(status == "SCORED", F.round(filled, 6)).alias("filled"))


@query(
    "candidate_scores",
    f"WITH {_CANDIDATES} SELECT user_id, post_id, type, status, reason, CASE WHEN status = 'SCORED' THEN round(least(1.0, greatest(0.0, raw)), 9) END AS score, CASE WHEN status = 'SCORED' THEN round(filled, 6) + 0.0 END AS filled FROM result",
    ("behaviour", "posts"),
)
def candidate_scores(d: Domain) -> DataFrame:
    return candidates(d)


@query(
    "candidate_orders",
    f"""WITH {_CANDIDATES}, r AS (SELECT user_id, post_id, type, status, round(least(1.0, greatest(0.0, raw)), 9) AS score, round(filled, 6) AS filled, list_position(['POST', 'JOURNEY', 'PLACE', 'CREW', 'REGION'], type) AS tr FROM result)
    SELECT user_id, post_id, status = 'SCORED' AS ranked, row_number() OVER (PARTITION BY user_id, status = 'SCORED' ORDER BY CASE WHEN status = 'SCORED' THEN -score END, CASE WHEN status = 'SCORED' THEN filled END, tr, post_id)::INTEGER AS place FROM r""",
    ("behaviour", "posts"),
)
def candidate_orders(d: Domain) -> DataFrame:
    """A member's scored candidates by score, neutral-filled weight, type and id; the terminal ones by type and id."""
    rank = F.array_position(F.array(*map(F.lit, (*TYPES, "REGION"))), F.col("type"))
    ranked = F.col("status") == "SCORED"
    rows = candidates(d).withColumns({"ranked": ranked, "type_rank": rank})
    w = Window.partitionBy("user_id", "ranked").orderBy(F.when(F.col("ranked"), -F.col("score")), "filled", "type_rank", "post_id")
    return rows.select("user_id", "post_id", "ranked", F.row_number().over(w).alias("place"))


# Policy of each segment of members.
#: Weights (context, interest, freshness, popularity), half-life in days, exponent of popularity, boost and threshold of low exposure.
SEGMENTS = {
    "empty": (0.30, 0.10, 0.35, 0.25, 14.0, 0.65, 0.10, 3),
    "explicit_only": (0.25, 0.45, 0.20, 0.10, 21.0, 0.70, 0.08, 3),
    "emerging": (0.25, 0.40, 0.20, 0.15, 21.0, 0.70, 0.08, 3),
    "established": (0.20, 0.55, 0.15, 0.10, 30.0, 0.75, 0.06, 2),
}
_POLICY_SQL = ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in SEGMENTS.items())
_SEGMENTED = f"""{_SCORED}, pol AS (SELECT * FROM (VALUES {_POLICY_SQL}) AS v(segment, wc, wi, wf, wp, hl, ex, bo, th)),
    g AS (SELECT segment, theme, t.post_id, round(pow(popular, ex), 9) AS adjusted, round(least(1.0, greatest(0.0, wc * coalesce(context, 0.5) + wi * interest + wf * coalesce(pow(0.5, greatest(0.0, ({_AGE})) / hl), 0.0) + wp * pow(popular, ex)
        + CASE WHEN views >= th THEN 0 ELSE bo * (th - views) / th END)), 9) AS score FROM t JOIN (SELECT post_id, published_at FROM posts) USING (post_id), pol)"""


def segment_rows(d: Domain) -> DataFrame:
    """Every candidate under each segment's policy (four fixed rows)."""
    fields = ("wc", "wi", "wf", "wp", "hl", "ex", "bo", "th")
    policies = F.array(*(F.struct(F.lit(k).alias("segment"), *(F.lit(float(x)).alias(n) for n, x in zip(fields, v, strict=True))) for k, v in SEGMENTS.items()))
    rows = scored(d).withColumn("p", F.explode(policies)).select("*", "p.*")
    fresh = F.coalesce(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), F.col("days")) / F.col("hl")), F.lit(0.0))
    boost = F.when(F.col("views") >= F.col("th"), 0.0).otherwise(F.col("bo") * (F.col("th") - F.col("views")) / F.col("th"))
    adjusted = F.pow("popular", F.col("ex"))
    score = F.col("wc") * F.coalesce("context", F.lit(0.5)) + F.col("wi") * F.col("interest") + F.col("wf") * fresh + F.col("wp") * adjusted + boost
    return rows.select("segment", "theme", "post_id", F.round(adjusted, 9).alias("adjusted"), F.round(scoring.clamp(score), 9).alias("score"))


@query("segment_scores", f"WITH {_SEGMENTED} SELECT segment, post_id, score FROM g", ("behaviour", "posts"))
def segment_scores(d: Domain) -> DataFrame:
    return segment_rows(d).select("segment", "post_id", "score")


@query(
    "segment_ranking",
    f"""WITH {_SEGMENTED} SELECT segment, theme, post_id, row_number() OVER (PARTITION BY segment, theme ORDER BY score DESC, adjusted DESC, post_id % 5, post_id)::INTEGER AS rank FROM g QUALIFY rank <= 100""",
    ("behaviour", "posts"),
)
def segment_ranking(d: Domain, most: int = 100) -> DataFrame:
    """A segment's first candidates of each theme: score, adjusted popularity, type, id."""
    w = Window.partitionBy("segment", "theme").orderBy(F.desc("score"), F.desc("adjusted"), F.col("post_id") % 5, "post_id")
    return segment_rows(d).select("segment", "theme", "post_id", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= most)


# Window, most promotion, most demotion, and caps (duplicate, author, region, theme) of each surface.
SURFACES = {
    "home_feed": (10, 8, 8, (1, 2, 4, 3)),
    "search_result": (12, 5, 5, (1, 3, 6, 4)),
    "journey_recommendation": (10, 7, 7, (1, 2, 4, 2)),
    "place_recommendation": (8, 4, 4, (1, 3, 4, 3)),
    "crew_recommendation": (8, 4, 4, (1, 2, 4, 3)),
}


@query(
    "decayed_interest",
    f"""SELECT user_id, post_id % 6 AS feature, round(sum(value / 100 * pow(0.5, (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(ts)) / 86400000.0 / 21)), 6) AS weight FROM behaviour WHERE kind <> 'report' GROUP BY 1, 2""",
    ("behaviour",),
)
def decayed_interest(d: Domain) -> DataFrame:
    age = scoring.age_days(F.col("ts"), now())
    return d.behaviour.filter("kind <> 'report'").groupBy("user_id", (F.col("post_id") % 6).alias("feature")).agg(F.round(F.sum(F.col("value") / 100 * F.pow(F.lit(0.5), age / 21)), 6).alias("weight"))


# Weights of events, half-life and look-back in days, most events, saturation, least strength, weight of explicit preferences, bounds of "established".
EVENT_WEIGHTS = {"view": 0.15, "click": 1.00, "save": 1.50, "follow": 1.25, "report": -3.00}
PROFILE_HALF_LIFE, LOOK_BACK, MOST_EVENTS, PROFILE_SATURATION, LEAST_STRENGTH, EXPLICIT_WEIGHT, ESTABLISHED = 21.0, 90, 5000, 8.0, 0.05, 12.0, (8, 2.0)

_PROFILE = f"""w AS (SELECT user_id, post_id % 6 AS feature, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, CASE kind {" ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_WEIGHTS.items())} END
        * pow(0.5, (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(ts)) / 86400000.0 / 21.0) AS w FROM behaviour WHERE ts <= TIMESTAMP '{NOW}' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY),
    x AS (SELECT * FROM w WHERE n <= 5000), b AS (SELECT user_id, feature, sum(w) AS w FROM x GROUP BY 1, 2), u AS (SELECT user_id, count(*) AS n, sum(abs(w)) AS total FROM x GROUP BY 1),
    e AS (SELECT user_id, user_id % 6 AS feature, CASE WHEN nation % 4 = 0 THEN -1 ELSE 1 END * (user_id % 4 + 1) / 4.0 * 12 AS w FROM members WHERE active),
    j AS (SELECT coalesce(b.user_id, e.user_id) AS user_id, coalesce(b.feature, e.feature) AS feature, coalesce(b.w, 0) + coalesce(e.w, 0) AS w, CASE WHEN b.w IS NULL THEN 'EXPLICIT' WHEN e.w IS NULL THEN 'BEHAVIOR' ELSE 'COMBINED' END AS source FROM b FULL JOIN e ON b.user_id = e.user_id AND b.feature = e.feature),
    signals AS (SELECT j.user_id, feature, w >= 0 AS prefer, 1 - exp(-abs(w) / 8) AS strength, source, CASE WHEN u.n IS NULL THEN 'explicit_only' WHEN u.n >= 8 AND u.total >= 2 THEN 'established' ELSE 'emerging' END AS segment FROM j LEFT JOIN u USING (user_id) WHERE 1 - exp(-abs(w) / 8) >= 0.05)"""


def signals(d: Domain) -> DataFrame:
    """Recent behaviour, decayed, with explicit preferences; strength saturates, weak signals go; the segment is the member's."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    weight = F.create_map(*(F.lit(x) for kv in EVENT_WEIGHTS.items() for x in kv))[F.col("kind")]
    x = (
        d.behaviour.filter((F.col("ts") <= now()) & (F.col("ts") >= now() - F.make_interval(days=F.lit(LOOK_BACK))))
        .withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= MOST_EVENTS)
        .select("user_id", (F.col("post_id") % 6).alias("feature"), (weight * F.pow(F.lit(0.5), scoring.age_days(F.col("ts"), now()) / PROFILE_HALF_LIFE)).alias("w"))
    )
    b = x.groupBy("user_id", "feature").agg(F.sum("w").alias("bw"), F.count("*").alias("n"), F.sum(F.abs("w")).alias("size"))
    sign = F.when(F.col("nation") % 4 == 0, -1.0).otherwise(1.0)
    e = d.members.filter("active").select("user_id", (F.col("user_id") % 6).alias("feature"), (sign * (F.col("user_id") % 4 + 1) / 4.0 * EXPLICIT_WEIGHT).alias("ew"))
    j = b.join(e, ["user_id", "feature"], "full").withColumn("w", F.coalesce("bw", F.lit(0.0)) + F.coalesce("ew", F.lit(0.0)))
    u = b.groupBy("user_id").agg(F.sum("n").alias("events"), F.sum("size").alias("total"))
    strength = 1 - F.exp(-F.abs("w") / PROFILE_SATURATION)
    segment = F.when(F.col("events").isNull(), "explicit_only").when((F.col("events") >= ESTABLISHED[0]) & (F.col("total") >= ESTABLISHED[1]), "established").otherwise("emerging")
    source = F.when(F.col("bw").isNull(), "EXPLICIT").when(F.col("ew").isNull(), "BEHAVIOR").otherwise("COMBINED")
    rows = j.join(u, "user_id", "left").withColumn("strength", strength).filter(F.col("strength") >= LEAST_STRENGTH)
    return rows.select("user_id", "feature", (F.col("w") >= 0).alias("prefer"), "strength", source.alias("source"), segment.alias("segment"))


@query("profile_signals", f"WITH {_PROFILE} SELECT user_id, feature, prefer, round(strength, 9) AS strength, source, segment FROM signals", ("behaviour", "members"))
def profile_signals(d: Domain) -> DataFrame:
    return signals(d).withColumn("strength", F.round("strength", 9))


@query(
    "signed_interest",
    f"""WITH {_PROFILE}, {_FEATURES}, f AS (SELECT DISTINCT post_id, feature FROM feats WHERE accepted)
    SELECT s.user_id, s.post_id, round(coalesce(0.5 + 0.5 * avg(CASE WHEN g.prefer THEN g.strength ELSE -g.strength END), 0.5), 9) AS interest FROM seen s LEFT JOIN f USING (post_id) LEFT JOIN signals g ON g.user_id = s.user_id AND g.feature = f.feature GROUP BY 1, 2""",
    ("behaviour", "members", "posts"),
)
def signed_interest(d: Domain) -> DataFrame:
    """Half plus half the mean signed strength of the matched features; neutral without a match."""
    f = post_features(d).filter("accepted").select("post_id", "feature").distinct()
    rows = seen_pairs(d).join(f, "post_id", "left").join(signals(d).select("user_id", "feature", F.when(F.col("prefer"), F.col("strength")).otherwise(-F.col("strength")).alias("v")), ["user_id", "feature"], "left")
    return rows.groupBy("user_id", "post_id").agg(F.round(scoring.clamp(F.coalesce(0.5 + 0.5 * F.avg("v"), F.lit(0.5))), 9).alias("interest"))


@query(
    "decay_and_saturation",
    f"""SELECT user_id, round(sum(CASE WHEN a <= 7 THEN 1.0 WHEN a <= 30 THEN 0.8 WHEN a <= 90 THEN 0.5 ELSE 0.25 END), 6) AS decayed, round(1 - exp(-greatest(0.0, sum(CASE WHEN kind = 'report' THEN -1.0 ELSE 0.5 END)) / 10), 9) AS saturated
    FROM (SELECT *, (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(ts)) / 86400000.0 AS a FROM behaviour) GROUP BY user_id""",
    ("behaviour",),
)
def decay_and_saturation(d: Domain) -> DataFrame:
    rows = d.behaviour.withColumn("a", scoring.age_days(F.col("ts"), now()))
    total = F.sum(F.when(F.col("kind") == "report", -1.0).otherwise(0.5))
    return rows.groupBy("user_id").agg(F.round(F.sum(scoring.time_decay(F.col("a"))), 6).alias("decayed"), F.round(scoring.saturate(total), 9).alias("saturated"))


# Least quality, most exposures, version.
LEAST_QUALITY, MOST_EXPOSURES, EXPLORATION_VERSION = 0.6, 2, "exploration-v1"
#: What stands before a candidate's id in its seed: version, snapshots, seed and type, with NULs between.
SEED_HEAD = "\x00".join((EXPLORATION_VERSION, "ranking-1", "metadata-1", "exploration-1", "seed-1", "post", ""))


def _fnv(text: str) -> int:
    h = 0x811C9DC5
    for byte in text.encode():
        h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
    return h


@query(
    "exploration_pool",
    f"""WITH {_SCORED}, v AS (SELECT post_id, count(*) AS shown FROM behaviour WHERE kind = 'view' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 4 DAY GROUP BY 1),
    q AS (SELECT post_id, theme, coalesce(shown, 0) AS shown, (CASE WHEN fresh IS NULL THEN 0 ELSE 4 * fresh END + CASE WHEN pop = 0 THEN 0 ELSE 3 * popular END) / nullif(CASE WHEN fresh IS NULL THEN 0 ELSE 4 END + CASE WHEN pop = 0 THEN 0 ELSE 3 END, 0) AS quality,
        list_reduce([{_fnv(SEED_HEAD)}::BIGINT] || list_transform(string_split(post_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda h, b: xor(h, b) * 16777619 % 4294967296) AS seed FROM t LEFT JOIN v USING (post_id))
    SELECT theme, post_id, shown, round(quality, 9) AS quality, seed, row_number() OVER (PARTITION BY theme ORDER BY shown, round(quality, 9) DESC, seed, post_id) AS place FROM q WHERE quality >= 0.6 AND shown <= 2""",
    ("behaviour", "posts"),
)
def exploration_pool(d: Domain) -> DataFrame:
    """Candidates little shown of late and of some quality: fewest exposures, best quality, seeded order. A candidate without behaviour has no popularity."""
    shown = d.behaviour.filter((F.col("kind") == "view") & (F.col("ts") >= now() - F.expr("interval 4 days"))).groupBy("post_id").agg(F.count("*").alias("shown"))
    raw = scoring.exploration_quality(F.col("fresh"), F.when(F.col("pop") > 0, F.col("popular")))
    rows = scored(d).join(shown, "post_id", "left").select("theme", "post_id", F.coalesce("shown", F.lit(0)).alias("shown"), raw.alias("raw"))
    rows = rows.filter((F.col("raw") >= LEAST_QUALITY) & (F.col("shown") <= MOST_EXPOSURES))
    rows = rows.select("theme", "post_id", "shown", F.round("raw", 9).alias("quality"), hashing.fnv1a32(F.concat(F.lit(SEED_HEAD), F.col("post_id").cast("string"))).alias("seed"))
    return ranked(rows, ["theme"], [F.asc("shown"), F.desc("quality"), F.asc("seed"), F.asc("post_id")], "place")


@query(
    "hash_buckets",
    """SELECT user_id, ('0x' || substr(sha256(username), 1, 8))::BIGINT % 10000 AS bucket, (('0x' || substr(sha256(username), 1, 16))::UBIGINT % 10000)::BIGINT AS sample,
    CASE WHEN ('0x' || substr(sha256(username), 1, 8))::BIGINT % 10000 < 5000 THEN 'baseline' ELSE 'treatment' END AS variant FROM members""",
    ("members",),
)
def hash_buckets(d: Domain) -> DataFrame:
    b = hashing.bucket(F.col("username"))
    return d.members.select("user_id", b.alias("bucket"), hashing.sampler(F.col("username")).alias("sample"), F.when(b < 5000, "baseline").otherwise("treatment").alias("variant"))


@query(
    "fnv_seeds",
    """WITH RECURSIVE f AS (SELECT region_id, slug, 1 AS i, 2166136261::BIGINT AS h FROM regions UNION ALL SELECT region_id, slug, i + 1, (xor(h, ascii(substr(slug, i, 1))::BIGINT)::HUGEINT * 16777619 % 4294967296)::BIGINT FROM f WHERE i <= length(slug))
    SELECT region_id, h AS seed FROM f WHERE i = length(slug) + 1""",
    ("regions",),
)
def fnv_seeds(d: Domain) -> DataFrame:
    return d.regions.select("region_id", hashing.fnv1a32(F.col("slug")).alias("seed"))


#: Features by theme; a small fixed vocabulary.
VOCABULARY = {"ECONOMY": "theme:budget", "STANDARD": "theme:common", "PROMO": "theme:event", "SMALL": "theme:walk", "LARGE": "theme:tour", "MEDIUM": "theme:day"}


@query(
    "vocabulary_lookup",
    f"""SELECT post_id, theme, f.feature, f.feature IS NOT NULL AS registered FROM posts LEFT JOIN (VALUES {', '.join(str(x) for x in VOCABULARY.items() if x[0] != 'MEDIUM')}) AS f(theme, feature) USING (theme)""",
    ("posts",),
)
def vocabulary_lookup(d: Domain) -> DataFrame:
    known = {k: v for k, v in VOCABULARY.items() if k != "MEDIUM"}
    lookup = F.create_map(*map(F.lit, chain.from_iterable(known.items())))
    feature = F.element_at(lookup, F.col("theme"))
    return d.posts.select("post_id", "theme", feature.alias("feature"), feature.isNotNull().alias("registered"))


#: Preferences as members send them, with two features that aren't registered, strengths of up to two, and repeats.
_SENT_IDS = [*vocabulary.IDS, "theme:unheard", "mood:"]
_SENT = f"""sent AS (SELECT event_id, user_id, ts, ({_SENT_IDS})[1 + (user_id * 5 + post_id) % {len(_SENT_IDS)}] AS feature, value / 100 AS strength, kind = 'report' AS avoided FROM behaviour WHERE kind IN ('save', 'report')),
    words AS (SELECT unnest({list(vocabulary.LABELS)}) AS feature, unnest({list(vocabulary.LABELS.values())}) AS label)"""


@query(
    "explicit_preferences",
    f"""WITH {_SENT}, j AS (SELECT s.*, w.label, w.label IS NOT NULL AND isfinite(strength) AND strength BETWEEN 0 AND 1 AS good FROM sent s LEFT JOIN words w USING (feature)),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, feature, good ORDER BY ts, event_id) AS n FROM j)
    SELECT event_id, user_id, feature, label, CASE WHEN label IS NULL THEN 'UNKNOWN_FEATURE' WHEN NOT good THEN 'STRENGTH_OUT_OF_RANGE' WHEN n > 1 THEN 'DUPLICATE_PREFERENCE' ELSE 'ACCEPTED' END AS outcome FROM n""",
    ("behaviour",),
)
def explicit_preferences(d: Domain) -> DataFrame:
    """Each preference against the vocabulary: unknown, of a strength outside 0..1, a repeat of the member's first valid one for the feature, or accepted."""
    place = ((F.col("user_id") * 5 + F.col("post_id")) % len(_SENT_IDS) + 1).cast("int")
    rows = d.behaviour.filter("kind in ('save', 'report')").select("event_id", "user_id", "ts", F.element_at(F.array(*map(F.lit, _SENT_IDS)), place).alias("feature"), (F.col("value") / 100).alias("strength"))
    rows = rows.withColumn("label", vocabulary.label(F.col("feature")))
    good = F.coalesce(F.col("label").isNotNull() & ~F.isnan("strength") & F.col("strength").between(0, 1), F.lit(False))
    rows = rows.withColumn("good", good)
    first = rows.filter("good").groupBy("user_id", "feature").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    rows = rows.join(first, ["user_id", "feature"], "left")
    outcome = F.when(F.col("label").isNull(), "UNKNOWN_FEATURE").when(~F.col("good"), "STRENGTH_OUT_OF_RANGE").when(F.col("event_id") != F.col("first.event_id"), "DUPLICATE_PREFERENCE").otherwise("ACCEPTED")
    return rows.select("event_id", "user_id", "feature", "label", outcome.alias("outcome"))


@query(
    "ranking_comparison",
    f"""WITH {_SCORED}, a AS (SELECT theme, post_id, row_number() OVER (PARTITION BY theme ORDER BY round(pop, 9) DESC, post_id) AS ra FROM t), b AS (SELECT theme, post_id, row_number() OVER (PARTITION BY theme ORDER BY round(coalesce(fresh, 0), 9) DESC, post_id) AS rb FROM t),
    j AS (SELECT * FROM a JOIN b USING (theme, post_id))
    SELECT theme, count(*) AS candidates, count(*) FILTER (WHERE ra <= 20 AND rb <= 20) AS shared_20, count(*) FILTER (WHERE ra = rb) AS unmoved, round(avg(abs(ra - rb)), 6) AS displacement, max(abs(ra - rb)) AS furthest FROM j GROUP BY theme""",
    ("behaviour", "posts"),
)
def ranking_comparison(d: Domain) -> DataFrame:
    """Two rankings of the same candidates, position by position."""
    rows = scored(d).select("theme", "post_id", F.round("pop", 9).alias("x"), F.round(F.coalesce("fresh", F.lit(0.0)), 9).alias("y"))
    rows = ranked(rows, ["theme"], [F.desc("x"), F.asc("post_id")], "ra")
    rows = ranked(rows, ["theme"], [F.desc("y"), F.asc("post_id")], "rb")
    moved = F.abs(F.col("ra") - F.col("rb"))
    return rows.groupBy("theme").agg(
        F.count("*").alias("candidates"), F.count_if((F.col("ra") <= 20) & (F.col("rb") <= 20)).alias("shared_20"), F.count_if(moved == 0).alias("unmoved"),
        F.round(F.avg(moved), 6).alias("displacement"), F.max(moved).alias("furthest"),
    )


@query(
    "window_cap_violations",
    """WITH w AS (SELECT a.run_id, a.rank, count(*) AS same FROM runs a JOIN runs b ON b.run_id = a.run_id AND b.rank BETWEEN a.rank - 4 AND a.rank AND b.post_id % 10 = a.post_id % 10 GROUP BY 1, 2)
    SELECT run_id, count(*) FILTER (WHERE same > 1) AS violations FROM w GROUP BY run_id""",
    ("runs",),
)
def window_cap_violations(d: Domain, window: int = 5, cap: int = 1) -> DataFrame:
    """Positions whose author group occurs more often than the cap in the trailing window."""
    w = Window.partitionBy("run_id").orderBy("rank").rowsBetween(-(window - 1), 0)
    rows = d.runs.withColumn("author", F.col("post_id") % 10).withColumn("recent", F.collect_list("author").over(w))
    same = F.size(F.filter("recent", lambda a: a == F.col("author")))
    return rows.groupBy("run_id").agg(F.count_if(same > cap).alias("violations"))
