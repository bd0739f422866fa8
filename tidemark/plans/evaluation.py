"""Offline evaluation: outcomes attributed to exposures, replays compared with stored runs, two policies compared, and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fingerprint import fold, row_hash, row_text, sql_fold, sql_text
from ..operators.ranking import ranked
from ..sources.tables import Domain, stamp
from .registry import query
from .scoring import _SEGMENTED, EVENT_WEIGHTS, counts, segment_rows

# Audit categories in order; windows of attribution by kind; cutoffs; least evidence.
CATEGORIES = (
    "MISSING_RECOMMENDATION_RUN", "ANONYMOUS_USER", "RUN_USER_SESSION_MISMATCH", "UNSUPPORTED_EVENT_TYPE", "MISSING_ENTITY_ID", "UNMATCHED_ENTITY",
    "AMBIGUOUS_ENTITY_IDENTITY", "AFTER_CUTOFF", "BEFORE_EXPOSURE", "OUTSIDE_ATTRIBUTION_WINDOW", "ATTRIBUTED",
)
SHORT_KINDS, SHORT_MINUTES, LONG_MINUTES = ("VIEW", "CLICK"), 30, 7 * 24 * 60
CUTOFFS = (5, 10, 20)
LEAST_REPLAYS, LEAST_OUTCOMES, LEAST_SUPPORT, EXACT_RATE = 30, 30, 0.8, 1.0
MISMATCHES = (
    "CURSOR_CHAIN", "SNAPSHOT_BINDING", "POLICY_BINDING", "SEED_BINDING", "STATUS", "COUNT", "SUMMARY", "PAGE_BOUNDARY", "CANDIDATE_IDENTITY", "CANDIDATE_RANK",
    "CANDIDATE_ORIGIN", "CANDIDATE_PROVENANCE", "SIGNED_ZERO", "FINGERPRINT",
)
#: The end of what is evaluated, and kinds of behaviour in the tables' stand-in for them.
CUTOFF = "2001-03-01 00:00:00"
KINDS = ("IMPRESSION", "SEARCH", "VIEW", "CLICK", "LIKE", "SAVE", "SHARE", "REPORT", "HIDE", "FOLLOW")

#: Orders are runs and their lines what was served, some of it again five days later; each line also stands for one behaviour.
_BEHAVIOUR = f"""lines AS (SELECT l_orderkey AS run, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, l_quantity, o_custkey AS owner, o_orderdate AS served FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    acts AS (SELECT run, owner, CASE WHEN part % 17 = 0 THEN NULL ELSE run END AS run_ref, CASE WHEN part % 19 = 0 THEN NULL ELSE owner END AS user_id, supp % 13 = 0 AS other, ({list(KINDS)})[1 + l_quantity::BIGINT % 10] AS kind,
        CASE WHEN supp % 23 = 0 THEN NULL WHEN part % 29 = 0 THEN part + 1 ELSE part END AS entity, served + ((part % 400 - 40) * 60) * INTERVAL 1 MINUTE AS acted FROM lines),
    shown AS (SELECT run, part AS entity, 'POST' AS type, served FROM lines UNION ALL SELECT run, part, 'POST', served + INTERVAL 5 DAY FROM lines WHERE line % 2 = 0 UNION ALL SELECT run, part, 'JOURNEY', served FROM lines WHERE supp % 31 = 0),
    identities AS (SELECT run, entity, count(DISTINCT type) AS types, list_sort(list(DISTINCT served)) AS times FROM shown GROUP BY 1, 2),
    placed AS (SELECT a.*, types, list_max(list_filter(times, lambda t: t <= a.acted)) AS served FROM acts a LEFT JOIN identities i ON i.run = a.run AND i.entity = a.entity),
    audited AS (SELECT *, CASE WHEN run_ref IS NULL THEN 'MISSING_RECOMMENDATION_RUN' WHEN user_id IS NULL THEN 'ANONYMOUS_USER' WHEN other THEN 'RUN_USER_SESSION_MISMATCH' WHEN kind IN ('IMPRESSION', 'SEARCH') THEN 'UNSUPPORTED_EVENT_TYPE' WHEN entity IS NULL THEN 'MISSING_ENTITY_ID'
        WHEN types IS NULL THEN 'UNMATCHED_ENTITY' WHEN types > 1 THEN 'AMBIGUOUS_ENTITY_IDENTITY' WHEN acted > TIMESTAMP '{CUTOFF}' THEN 'AFTER_CUTOFF' WHEN served IS NULL THEN 'BEFORE_EXPOSURE'
        WHEN acted > least(TIMESTAMP '{CUTOFF}', served + CASE WHEN kind IN ('VIEW', 'CLICK') THEN INTERVAL 30 MINUTE ELSE INTERVAL 7 DAY END) THEN 'OUTSIDE_ATTRIBUTION_WINDOW' ELSE 'ATTRIBUTED' END AS category FROM placed)"""


def audited(d: Domain) -> DataFrame:
    """Every behaviour with the first category that holds.

    Lines meet their order once; behaviours and exposures then stay where their run is. In order of time within a run and entity, a behaviour's latest
    exposure is the greatest time of one so far."""
    orders, items = d.dealt()
    o = orders.select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("owner"), stamp("o_orderdate").alias("shown_at"))
    lines = items.select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line"), "l_quantity").join(o, "run")
    minutes = F.make_dt_interval(mins=((F.col("part") % 400 - 40) * 60).cast("int"))
    none = F.lit(None)
    act = F.struct(
        none.cast("string").alias("type"), F.when(F.col("supp") % 23 == 0, None).when(F.col("part") % 29 == 0, F.col("part") + 1).otherwise(F.col("part")).alias("entity"), (F.col("shown_at") + minutes).alias("at"),
        F.when(F.col("part") % 17 == 0, None).otherwise(F.col("run")).alias("run_ref"), F.when(F.col("part") % 19 == 0, None).otherwise(F.col("owner")).alias("user_id"), (F.col("supp") % 13 == 0).alias("other"),
        F.element_at(F.array(*map(F.lit, KINDS)), (1 + F.col("l_quantity").cast("long") % 10).cast("int")).alias("kind"),
    )
    shown = lambda type_, at: F.struct(
        F.lit(type_).alias("type"), F.col("part").alias("entity"), at.alias("at"), none.cast("long").alias("run_ref"), none.cast("long").alias("user_id"), none.cast("boolean").alias("other"), none.cast("string").alias("kind")
    )
    again = F.when(F.col("line") % 2 == 0, shown("POST", F.col("shown_at") + F.expr("interval 5 days")))
    twice = F.when(F.col("supp") % 31 == 0, shown("JOURNEY", F.col("shown_at")))
    both = lines.select("run", "owner", F.explode(F.array(act, shown("POST", F.col("shown_at")), again, twice)).alias("r")).filter(F.col("r").isNotNull()).select("run", "owner", "r.*")
    # an entity of the run; nothing is known of a missing one
    w = Window.partitionBy("run", "entity").orderBy(F.asc_nulls_first("at"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = lambda c: F.when(F.col("entity").isNotNull(), c)
    rows = both.select("*", F.min("type").over(whole).alias("least"), F.max("type").over(whole).alias("most"), F.max(F.when(F.col("type").isNotNull(), F.col("at"))).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("latest"))
    types = F.when(F.col("least").isNotNull(), F.when(F.col("least") == F.col("most"), 1).otherwise(2))
    rows = rows.filter("type is null").select("run", "owner", "run_ref", "user_id", "other", "kind", "entity", "at", known(types).alias("types"), known(F.col("latest")).alias("served"))
    cutoff = F.lit(CUTOFF).cast("timestamp")
    end = F.col("served") + F.when(F.col("kind").isin(*SHORT_KINDS), F.expr(f"interval {SHORT_MINUTES} minutes")).otherwise(F.expr(f"interval {LONG_MINUTES} minutes"))
    tests = (
        F.col("run_ref").isNull(), F.col("user_id").isNull(), F.col("other"), F.col("kind").isin("IMPRESSION", "SEARCH"), F.col("entity").isNull(), F.col("types").isNull(), F.col("types") > 1,
        F.col("at") > cutoff, F.col("served").isNull(), F.col("at") > F.least(cutoff, end),
    )
    category = F.when(tests[0], CATEGORIES[0])
    for test, name in zip(tests[1:], CATEGORIES[1:], strict=False):
        category = category.when(test, name)
    return rows.withColumn("category", category.otherwise(CATEGORIES[-1]))


@query("outcome_attribution", f"WITH {_BEHAVIOUR} SELECT k.category, count(a.category) AS n FROM (SELECT unnest({list(CATEGORIES)}) AS category) k LEFT JOIN audited a USING (category) GROUP BY 1")
def outcome_attribution(d: Domain) -> DataFrame:
    """Behaviours per category; categories without any count 0."""
    wide = audited(d).agg(*(F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES))
    return wide.unpivot([], list(CATEGORIES), "category", "n")


_SNAP = sql_fold(sql_text("post_id", "round(discount * 1000)::BIGINT"))
_SIDES = """a AS (SELECT run_id, user_id, rank::INTEGER AS idx, rank::INTEGER AS rank, post_id, quantity, discount, discount > 0.05 AS explored, false AS negative, ran_at FROM runs),
    b AS (SELECT run_id, user_id, (rank - CASE WHEN run_id % 11 = 0 THEN 1 ELSE 0 END)::INTEGER AS idx, (rank + CASE WHEN run_id % 31 = 0 THEN 1 ELSE 0 END)::INTEGER AS rank, CASE WHEN run_id % 7 = 0 AND rank = 2 THEN post_id + 1 ELSE post_id END AS post_id,
        quantity, CASE WHEN run_id % 5 = 0 THEN discount + 0.01 ELSE discount END AS discount, (discount > 0.05) <> (run_id % 37 = 0) AS explored, run_id % 41 = 0 AND discount = 0 AS negative, ran_at + INTERVAL 2 DAY AS ran_at FROM runs WHERE NOT (run_id % 11 = 0 AND rank = 1)),
    ea AS (SELECT *, substr(sha256(user_id || '|' || snap || '|' || policy), 1, 8) AS seed FROM (SELECT run_id, min(user_id) AS user_id, count(*) AS n, sum(quantity) AS total, min(rank) AS lo, max(rank) AS hi, md5(string_agg(post_id::VARCHAR, ',' ORDER BY rank)) AS print, list_reduce([''] || list(post_id::VARCHAR ORDER BY rank), lambda c, x: sha256(c || ':' || x)) AS chain,
        {SNAP} AS snap, 'policy-' || year(max(ran_at)) AS policy, CASE WHEN count(*) >= 4 THEN 'FULL' ELSE 'PARTIAL' END AS status FROM a GROUP BY 1)),
    eb AS (SELECT *, substr(sha256(user_id || '|' || snap || '|' || policy), 1, 8) AS seed FROM (SELECT run_id, min(user_id) AS user_id, count(*) AS n, sum(quantity) AS total, min(rank) AS lo, max(rank) AS hi, md5(string_agg(post_id::VARCHAR, ',' ORDER BY rank)) AS print, list_reduce([''] || list(post_id::VARCHAR ORDER BY rank), lambda c, x: sha256(c || ':' || x)) AS chain,
        {SNAP} AS snap, 'policy-' || year(max(ran_at)) AS policy, CASE WHEN count(*) >= 4 THEN 'FULL' ELSE 'PARTIAL' END AS status FROM b GROUP BY 1)),
    found AS (SELECT run_id, unnest(list_filter([CASE WHEN eb.n IS NULL OR ea.chain <> eb.chain THEN 'CURSOR_CHAIN' END, CASE WHEN eb.n IS NULL OR ea.snap <> eb.snap THEN 'SNAPSHOT_BINDING' END, CASE WHEN eb.n IS NULL OR ea.policy <> eb.policy THEN 'POLICY_BINDING' END, CASE WHEN eb.n IS NULL OR ea.seed <> eb.seed THEN 'SEED_BINDING' END, CASE WHEN eb.n IS NULL OR ea.status <> eb.status THEN 'STATUS' END,
            CASE WHEN eb.n IS NULL OR ea.n <> eb.n THEN 'COUNT' END, CASE WHEN eb.n IS NULL OR ea.total <> eb.total THEN 'SUMMARY' END, CASE WHEN eb.n IS NULL OR ea.lo <> eb.lo OR ea.hi <> eb.hi THEN 'PAGE_BOUNDARY' END, CASE WHEN eb.n IS NULL OR ea.print <> eb.print THEN 'FINGERPRINT' END], lambda x: x IS NOT NULL)) AS category FROM ea LEFT JOIN eb USING (run_id)
        UNION ALL SELECT coalesce(a.run_id, b.run_id), unnest(list_filter(CASE WHEN a.run_id IS NULL OR b.run_id IS NULL THEN ['CANDIDATE_IDENTITY'] ELSE [CASE WHEN a.post_id <> b.post_id THEN 'CANDIDATE_IDENTITY' END, CASE WHEN a.rank <> b.rank THEN 'CANDIDATE_RANK' END, CASE WHEN a.explored <> b.explored THEN 'CANDIDATE_ORIGIN' END,
            CASE WHEN abs(a.discount - b.discount) > 1e-9 OR a.quantity <> b.quantity THEN 'CANDIDATE_PROVENANCE' END, CASE WHEN a.negative <> b.negative THEN 'SIGNED_ZERO' END] END, lambda x: x IS NOT NULL)) FROM a FULL JOIN b ON a.run_id = b.run_id AND a.idx = b.idx)""".replace("{SNAP}", _SNAP)


def both_sides(d: Domain) -> DataFrame:
    """Stored candidates (side a) and replayed ones (b): run_id, side, user_id, idx (position), rank, post_id, quantity, discount, explored, negative, ran_at, scaled.

    The replay stands two days later and differs in some candidates; what binds a run is computed from each side's own rows."""
    run, rank, post, discount = (F.col(c) for c in ("run_id", "rank", "post_id", "discount"))
    names = ("side", "idx", "rank", "post_id", "discount", "explored", "negative", "ran_at")
    of = lambda *values: F.struct(*(v.alias(n) for n, v in zip(names, values, strict=True)))
    a = of(F.lit("a"), rank, rank, post, discount, discount > 0.05, F.lit(False), F.col("ran_at"))
    b = of(
        F.lit("b"), rank - F.when(run % 11 == 0, 1).otherwise(0), rank + F.when(run % 31 == 0, 1).otherwise(0), F.when((run % 7 == 0) & (rank == 2), post + 1).otherwise(post),
        F.when(run % 5 == 0, discount + 0.01).otherwise(discount), (discount > 0.05) != (run % 37 == 0), (run % 41 == 0) & (discount == 0), F.col("ran_at") + F.expr("interval 2 days"),
    )
    sides = d.runs.select("run_id", "user_id", "quantity", F.explode(F.array(a, F.when(~((run % 11 == 0) & (rank == 1)), b))).alias("r")).filter(F.col("r").isNotNull())
    return sides.select("run_id", "user_id", "quantity", "r.*").withColumn("scaled", F.round(F.col("discount") * 1000).cast("long"))


def _binding(side: str) -> dict[str, Column]:
    """Aggregates of a run that bind one side's candidates as a whole, each of them null where it has none."""
    c = lambda name: F.when(F.col(f"{side}.here"), F.col(f"{side}.{name}"))
    n = F.count(c("rank"))
    ids = F.transform(F.sort_array(F.collect_list(F.when(F.col(f"{side}.here"), F.struct(c("rank").alias("rank"), c("post_id").alias("post_id"))))), lambda x: x["post_id"].cast("string"))
    return {
        "n": n, "user": F.min(c("user_id")), "total": F.sum(c("quantity")), "lo": F.min(c("rank")), "hi": F.max(c("rank")), "ids": ids, "snap": fold(F.when(F.col(f"{side}.here"), F.col(f"{side}.hash"))), "year": F.year(F.max(c("ran_at"))),
    }


def replay_counts(d: Domain) -> DataFrame:
    """run_id, user_id and the number of mismatches of each category of a stored or replayed run; user_id is null where nothing is stored.

    Candidates of both sides stay where their run is: positions are brought together first, then runs, in one pass over the lines."""
    x = both_sides(d).withColumn("hash", row_hash(row_text("post_id", "scaled"))).groupBy("run_id", "idx")
    one = F.struct("user_id", "rank", "post_id", "quantity", "discount", "explored", "negative", "ran_at", "hash")
    met = x.agg(*(F.collect_list(F.when(F.col("side") == s, one)).alias(s) for s in "ab"))
    # as a full join by position does; a candidate that meets several is bound once
    met = met.select("run_id", F.posexplode_outer("a").alias("i", "a"), "b").select("run_id", "i", "a", F.posexplode_outer("b").alias("j", "b"))
    first = lambda s, other: F.struct(F.expr(f"{s} is not null and coalesce({other}, 0) = 0").alias("here"), f"{s}.*")
    met = met.select("run_id", first("a", "j").alias("a"), first("b", "i").alias("b"), F.expr("a is null or b is null").alias("lone"))
    tests = [
        ("CANDIDATE_IDENTITY", F.col("lone") | F.expr("a.post_id <> b.post_id")), ("CANDIDATE_RANK", F.expr("a.rank <> b.rank")), ("CANDIDATE_ORIGIN", F.expr("a.explored <> b.explored")),
        ("CANDIDATE_PROVENANCE", F.expr("abs(a.discount - b.discount) > 1e-9 or a.quantity <> b.quantity")), ("SIGNED_ZERO", F.expr("a.negative <> b.negative")),
    ]
    runs = met.groupBy("run_id").agg(*(F.count_if(t).alias(k) for k, t in tests), *(v.alias(f"{s}_{k}") for s in "ab" for k, v in _binding(s).items()))
    for s in "ab":
        ids = F.col(f"{s}_ids")
        runs = runs.withColumns({
            f"{s}_print": F.md5(F.array_join(ids, ",")), f"{s}_chain": F.aggregate(ids, F.lit(""), lambda c, v: F.sha2(F.concat(c, F.lit(":"), v), 256)), f"{s}_policy": F.concat(F.lit("policy-"), F.col(f"{s}_year").cast("string")),
            f"{s}_status": F.when(F.col(f"{s}_n") >= 4, "FULL").otherwise("PARTIAL"),
        }).withColumn(f"{s}_seed", F.substring(F.sha2(F.concat_ws("|", f"{s}_user", f"{s}_snap", f"{s}_policy"), 256), 1, 8))
    differ = lambda *cs: F.expr("a_n > 0 and not coalesce(b_n > 0 and " + " and ".join(f"a_{c} = b_{c}" for c in cs) + ", false)").cast("long")
    whole = {
        "CURSOR_CHAIN": differ("chain"), "SNAPSHOT_BINDING": differ("snap"), "POLICY_BINDING": differ("policy"), "SEED_BINDING": differ("seed"), "STATUS": differ("status"), "COUNT": differ("n"), "SUMMARY": differ("total"), "PAGE_BOUNDARY": differ("lo", "hi"), "FINGERPRINT": differ("print"),
    }
    return runs.select("run_id", F.col("a_user").alias("user_id"), *(whole.get(c, F.col(c)).alias(c) for c in MISMATCHES))


@query(
    "replay_comparison",
    f"WITH {_SIDES} SELECT k.category, count(f.run_id) AS mismatches, count(DISTINCT f.run_id) AS runs FROM (SELECT unnest({list(MISMATCHES)}) AS category) k LEFT JOIN found f USING (category) GROUP BY 1",
    ("runs",),
)
def replay_comparison(d: Domain) -> DataFrame:
    """Mismatches and runs with them per category, over all stored runs; categories without any count 0."""
    rows = replay_counts(d)
    one = rows.agg(F.array(*(F.struct(F.lit(c).alias("category"), F.coalesce(F.sum(c), F.lit(0)).alias("mismatches"), F.count_if(F.col(c) > 0).alias("runs")) for c in MISMATCHES)).alias("found"))
    return one.select(F.inline("found"))


_WEIGHTS = " + ".join(f"{EVENT_WEIGHTS[k]} * coalesce({n}, 0)" for n, k in (("views", "view"), ("likes", "click"), ("saves", "save"), ("shares", "follow")))
_COMPARED = f"""{_SEGMENTED},
    two AS (SELECT theme, post_id, max(CASE WHEN segment = 'empty' THEN r END) AS ra, max(CASE WHEN segment = 'established' THEN r END) AS rb FROM (SELECT theme, post_id, segment, row_number() OVER (PARTITION BY theme, segment ORDER BY score DESC, adjusted DESC, post_id) AS r FROM g WHERE segment IN ('empty', 'established')) GROUP BY 1, 2),
    full_ AS (SELECT two.*, k, p.author_id, p.region_id, p.brand, c.post_id IS NOT NULL AS supported, {_WEIGHTS} AS value FROM two JOIN posts p USING (post_id) LEFT JOIN c USING (post_id), (VALUES (5), (10), (20)) v(k) WHERE ra <= k OR rb <= k),
    compared AS (SELECT theme, k, count(*) FILTER (WHERE ra <= k AND rb <= k) AS shared, count(*) AS either, count(*) FILTER (WHERE ra <= k) AS na, count(*) FILTER (WHERE rb <= k) AS nb, avg(abs(ra - rb)) FILTER (WHERE ra <= k AND rb <= k) AS mean_shift, max(abs(ra - rb)) FILTER (WHERE ra <= k AND rb <= k) AS max_shift,
        count(DISTINCT author_id) FILTER (WHERE rb <= k) - count(DISTINCT author_id) FILTER (WHERE ra <= k) AS more_authors, count(DISTINCT region_id) FILTER (WHERE rb <= k) - count(DISTINCT region_id) FILTER (WHERE ra <= k) AS more_regions,
        count(*) FILTER (WHERE rb <= k) - count(DISTINCT brand) FILTER (WHERE rb <= k) AS collisions, count(*) FILTER (WHERE rb <= k AND supported) AS supported, coalesce(sum(value) FILTER (WHERE rb <= k AND supported), 0) AS value FROM full_ GROUP BY 1, 2)"""


def compared(d: Domain) -> DataFrame:
    """Two policies at each cutoff, per theme: overlap, shifts, diversity, and what was observed of the second's candidates.

    Ranks are cut at the largest cutoff before candidates meet."""
    rows = segment_rows(d).filter(F.col("segment").isin("empty", "established"))
    rows = ranked(rows, ["theme", "segment"], [F.desc("score"), F.desc("adjusted"), F.asc("post_id")], "r")
    rank = lambda s: F.max(F.when(F.col("segment") == s, F.col("r")))
    two = rows.groupBy("theme", "post_id").agg(rank("empty").alias("ra"), rank("established").alias("rb")).filter(F.least("ra", "rb") <= max(CUTOFFS))
    value = sum(
        (EVENT_WEIGHTS[k] * F.coalesce(n, F.lit(0)) for n, k in (("views", "view"), ("likes", "click"), ("saves", "save"), ("shares", "follow"))), F.lit(0.0)
    )
    posts = d.posts.select("post_id", "author_id", "region_id", "brand")
    full = two.join(posts, "post_id").join(counts(d).withColumn("supported", F.lit(True)), "post_id", "left").select(
        "theme", "ra", "rb", "author_id", "region_id", "brand", F.coalesce("supported", F.lit(False)).alias("supported"), value.alias("value"), F.explode(F.array(*map(F.lit, CUTOFFS))).alias("k")
    )
    a, b, shift = F.col("ra") <= F.col("k"), F.col("rb") <= F.col("k"), F.abs(F.col("ra") - F.col("rb"))
    n = lambda test, c: F.size(F.collect_set(F.when(test, F.col(c))))  # noqa: E731 - at most a cutoff of values
    return full.filter(a | b).groupBy("theme", "k").agg(
        F.count_if(a & b).alias("shared"), F.count("*").alias("either"), F.count_if(a).alias("na"), F.count_if(b).alias("nb"), F.avg(F.when(a & b, shift)).alias("mean_shift"), F.max(F.when(a & b, shift)).alias("max_shift"),
        (n(b, "author_id") - n(a, "author_id")).alias("more_authors"), (n(b, "region_id") - n(a, "region_id")).alias("more_regions"), (F.count_if(b) - n(b, "brand")).alias("collisions"),
        F.count_if(b & F.col("supported")).alias("supported"), F.coalesce(F.sum(F.when(b & F.col("supported"), F.col("value"))), F.lit(0.0)).alias("value"),
    )


@query(
    "policy_comparison",
    f"""WITH {_COMPARED}
    SELECT theme, k, shared, either, round(shared / either, 9) AS jaccard, round(shared / least(na, nb), 9) AS overlap, round(mean_shift, 6) AS mean_shift, max_shift, more_authors, more_regions, collisions, supported, round(supported / nb, 9) AS coverage, round(value, 6) AS value FROM compared""",
    ("behaviour", "posts"),
)
def policy_comparison(d: Domain) -> DataFrame:
    r = lambda c, n: F.round(c, n)
    return compared(d).select(
        "theme", "k", "shared", "either", r(F.col("shared") / F.col("either"), 9).alias("jaccard"), r(F.col("shared") / F.least("na", "nb"), 9).alias("overlap"), r("mean_shift", 6).alias("mean_shift"), "max_shift",
        "more_authors", "more_regions", "collisions", "supported", r(F.col("supported") / F.col("nb"), 9).alias("coverage"), r("value", 6).alias("value"),
    )


def decide(rows: DataFrame) -> DataFrame:
    """Adds decision and the first reason: blocked by a mismatch or violation, too little evidence, a guardrail to review, or passed.

    rows: replays, exact, outcomes, supported, candidates, violations, breaches."""
    rate = F.coalesce(F.try_divide("exact", "replays"), F.lit(0.0))
    support = F.coalesce(F.try_divide("supported", "candidates"), F.lit(1.0))
    reason = (
        F.when(F.col("exact") < F.col("replays"), "REPLAY_MISMATCH").when(F.col("violations") > 0, "INVARIANT_VIOLATION")
        .when(F.col("replays") < LEAST_REPLAYS, "MINIMUM_REPLAY_CASE_COUNT").when(F.col("outcomes") < LEAST_OUTCOMES, "MINIMUM_ATTRIBUTED_OUTCOME_EVENT_COUNT")
        .when(rate < EXACT_RATE, "EXACT_REPLAY_REQUIRED_RATE").when(support < LEAST_SUPPORT, "MINIMUM_COMMON_SUPPORT_COVERAGE_AT_10").when(F.col("breaches") > 0, "GUARDRAIL_BREACH")
    )
    blocked = reason.isin("REPLAY_MISMATCH", "INVARIANT_VIOLATION")
    decision = F.when(reason.isNull(), "PASS").when(blocked, "BLOCK").when(reason == "GUARDRAIL_BREACH", "REVIEW").otherwise("INSUFFICIENT_EVIDENCE")
    return rows.withColumns({"decision": decision, "reason": reason})


@query(
    "evaluation_decision",
    f"""WITH {_SIDES}, {_BEHAVIOUR}, cases AS (SELECT a.user_id, count(DISTINCT a.run_id) AS replays, count(DISTINCT CASE WHEN f.run_id IS NULL THEN a.run_id END) AS exact FROM a LEFT JOIN (SELECT DISTINCT run_id FROM found) f ON f.run_id = a.run_id GROUP BY 1),
    won AS (SELECT owner, count(*) FILTER (WHERE category = 'ATTRIBUTED') AS outcomes, count(*) FILTER (WHERE category = 'ATTRIBUTED' AND kind = 'REPORT') AS severe, count(*) FILTER (WHERE types IS NOT NULL) AS supported, count(*) AS candidates FROM audited GROUP BY 1),
    j AS (SELECT user_id, replays, exact, outcomes, severe, CASE WHEN exact < replays THEN 'REPLAY_MISMATCH' WHEN replays < {LEAST_REPLAYS} THEN 'MINIMUM_REPLAY_CASE_COUNT' WHEN outcomes < {LEAST_OUTCOMES} THEN 'MINIMUM_ATTRIBUTED_OUTCOME_EVENT_COUNT'
        WHEN supported / candidates < {LEAST_SUPPORT} THEN 'MINIMUM_COMMON_SUPPORT_COVERAGE_AT_10' WHEN severe > 0 THEN 'GUARDRAIL_BREACH' END AS reason FROM cases JOIN won ON owner = user_id)
    SELECT user_id, replays, exact, outcomes, CASE WHEN reason IS NULL THEN 'PASS' WHEN reason = 'REPLAY_MISMATCH' THEN 'BLOCK' WHEN reason = 'GUARDRAIL_BREACH' THEN 'REVIEW' ELSE 'INSUFFICIENT_EVIDENCE' END AS decision, reason FROM j""",
    ("runs",),
)
def evaluation_decision(d: Domain) -> DataFrame:
    """Per member: replays of the member's runs, attributed outcomes, support, and what they decide."""
    runs = replay_counts(d).filter(F.col("user_id").isNotNull())
    cases = runs.groupBy("user_id").agg(F.count("*").alias("replays"), F.count_if(F.greatest(*MISMATCHES) == 0).alias("exact"))
    hit = F.col("category") == "ATTRIBUTED"
    won = audited(d).groupBy(F.col("owner").alias("user_id")).agg(F.count_if(hit).alias("outcomes"), F.count_if(hit & (F.col("kind") == "REPORT")).alias("breaches"), F.count_if(F.col("types").isNotNull()).alias("supported"), F.count("*").alias("candidates"))
    return decide(cases.join(won, "user_id").withColumn("violations", F.lit(0))).select("user_id", "replays", "exact", "outcomes", "decision", "reason")
