"""Exposure events built from served pages: checked, then bound by the digests of what was replayed and of what was shown.

Pages are orders with their first five lines; lines that came back are exploration, discounts are scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..functions.canonical import canonical, listed, negative_zero, written
from ..sources.tables import Domain
from .registry import query

# Versions that an event names, the largest page, the longest seed in bytes, origins, a candidate's keys in order.
SCHEMA, CURSOR, RANKING, HARD_PAGE, SEED_BYTES = "recommendation-exposure-v1", "ranking-cursor-v3", "ranking-v3", 100, 128
PERSONALIZED, EXPLORATION = "PERSONALIZED", "EXPLORATION"
CANDIDATE = (
    ("entityId", "string"), ("entityType", "string"), ("absoluteRank", "int"), ("pagePosition", "int"), ("origin", "string"), ("score", "double"), ("scoreIsNegativeZero", "boolean"), ("baseAbsoluteRank", "int"), ("diversifiedAbsoluteRank", "int"),
    ("explorationQualityScore", "double"), ("recentExposureCount", "bigint"), ("seededTieBreakKey", "bigint"), ("explorationPoolRank", "int"), ("targetInsertionRank", "int"),
)
NAMES = ("rankingSnapshotId", "metadataSnapshotId", "explorationSnapshotId", "userId", "contextId", "baseIntegrationPolicyVersion", "baseRankingPolicyVersion", "scorePolicyVersion", "diversityPolicyVersion", "explorationPolicyVersion", "explorationSeed")
COUNTS = ("inputCount", "scoredCount", "sourceTerminalCount", "personalizedCount", "insertedCount", "finalRankedCandidateCount", "terminalCandidateCount")
#: Why a page gives no event: (refusal, condition), the first that holds.
RULES = (
    ("RANKING_POLICY", f"not (rankingPolicyVersion <=> '{RANKING}')"),
    ("NAME_BLANK", " or ".join(f"not coalesce({n} rlike '[^ \\\\t\\\\r\\\\n]', false)" for n in NAMES)),
    ("SEED_TOO_LONG", f"octet_length(explorationSeed) > {SEED_BYTES}"),
    ("COUNT_NEGATIVE", " or ".join(f"coalesce({c} < 0, true)" for c in COUNTS)),
    (
        "COUNT_INVARIANT",
        "inputCount <> scoredCount + sourceTerminalCount or personalizedCount <> scoredCount or finalRankedCandidateCount <> personalizedCount + insertedCount "
        "or terminalCandidateCount <> sourceTerminalCount - insertedCount or inputCount <> finalRankedCandidateCount + terminalCandidateCount",
    ),
    ("PAGE_LIMIT", f"coalesce(effectiveLimit < 1 or effectiveLimit > {HARD_PAGE} or size(candidates) > effectiveLimit, true) or requestedLimit < 1"),
    ("EMPTY_PAGE", "size(candidates) = 0 and (pageStartRank is not null or pageEndRank is not null or hasNextPage or nextCursor is not null)"),
    ("EMPTY_RESULT", "size(candidates) = 0 and not (status = 'EMPTY' and emptyReason is not null and finalRankedCandidateCount = 0 or status = 'RANKED' and emptyReason is null and finalRankedCandidateCount > 0)"),
    ("PAGE_RANK_BOUNDARY", "size(candidates) > 0 and not (candidates[0].absoluteRank <=> pageStartRank and candidates[size(candidates) - 1].absoluteRank <=> pageEndRank)"),
    (
        "RANK_DISCONTINUITY",
        "case when size(candidates) > 0 then not (candidates.absoluteRank <=> coalesce(sequence(candidates[0].absoluteRank, candidates[0].absoluteRank + size(candidates) - 1), array_repeat(candidates[0].absoluteRank, size(candidates)))) end",
    ),
    ("NEXT_CURSOR", "not (hasNextPage <=> (nextCursor is not null))"),
    ("DUPLICATE_IDENTITY", "size(array_distinct(candidates.identity)) < size(candidates)"),
    ("RANK_BEYOND_FINAL", "array_max(candidates.absoluteRank) > finalRankedCandidateCount"),
    *((name, f"array_contains(candidates.fault, '{name}')") for name in ("PERSONALIZED_CANDIDATE", "EXPLORATION_CANDIDATE", "UNSUPPORTED_ORIGIN")),
)
_REPLAY = (
    "schemaVersion", "userId", "contextId", "cursorVersion", "rankingSnapshotId", "metadataSnapshotId", "explorationSnapshotId", "rankingPolicyVersion", "baseIntegrationPolicyVersion", "baseRankingPolicyVersion", "scorePolicyVersion",
    "componentPolicyVersions", "diversityPolicyVersion", "explorationPolicyVersion", "explorationSeed",
)
_PAGE = (
    "replayKey", "rankingStatus", "rankingEmptyReason", "requestedLimit", "effectiveLimit", "pageStartRank", "pageEndRank", "pageCandidateCount", "hasNextPage", "inputCount", "finalRankedCandidateCount", "terminalCandidateCount",
    "diversitySummary", "explorationSummary", "candidates",
)


def _projected(c: Column, position: Column) -> list[Column]:
    """A candidate's values in canonical order; what belongs to the other origin is null."""
    own = {"score": PERSONALIZED, "baseAbsoluteRank": PERSONALIZED, "diversifiedAbsoluteRank": PERSONALIZED} | dict.fromkeys(("explorationQualityScore", "recentExposureCount", "seededTieBreakKey", "explorationPoolRank", "targetInsertionRank"), EXPLORATION)
    made = {"pagePosition": position + 1, "scoreIsNegativeZero": F.coalesce((c["origin"] == PERSONALIZED) & negative_zero(c["score"]), F.lit(False))}
    fields = [made[n] if n in made else F.when(c["origin"] == own[n], c[n]) if n in own else c[n] for n, _ in CANDIDATE]
    return [f.cast(t) for f, (_, t) in zip(fields, CANDIDATE, strict=True)]


def _of_unit(x: Column) -> Column:
    return F.coalesce((x >= 0) & (x <= 1) & ~F.isnan(x), F.lit(False))


def seen(c: Column, position: Column) -> Column:
    """What a page's rules and print need of a candidate at a position from 0: absoluteRank, identity, fault (the rule of RULES that it breaks by itself) and text, its JSON."""
    own = _of_unit(c["score"]) & F.coalesce((c["baseAbsoluteRank"] > 0) & (c["diversifiedAbsoluteRank"] > 0), F.lit(False))
    explored = _of_unit(c["explorationQualityScore"]) & F.coalesce(
        (c["recentExposureCount"] >= 0) & c["seededTieBreakKey"].between(0, 4294967295) & (c["explorationPoolRank"] > 0) & (c["targetInsertionRank"] > 0), F.lit(False)
    )
    fault = F.when(c["origin"] == PERSONALIZED, F.when(~own, "PERSONALIZED_CANDIDATE")).when(c["origin"] == EXPLORATION, F.when(~explored, "EXPLORATION_CANDIDATE")).otherwise("UNSUPPORTED_ORIGIN")
    fields = _projected(c, position)
    text = written({n: canonical(x, DataType.fromDDL(t)) for (n, t), x in zip(CANDIDATE, fields, strict=True)})
    return F.struct(c["absoluteRank"].alias("absoluteRank"), F.struct(c["entityType"], c["entityId"]).alias("identity"), fault.alias("fault"), text.alias("text"))


def build(pages: DataFrame) -> DataFrame:
    """pages with refusal, replayKey and pageFingerprint, both null where it is refused. All within the row: a page has at most HARD_PAGE candidates.

    pages: NAMES, COUNTS, rankingPolicyVersion, status, emptyReason, requestedLimit, effectiveLimit, pageStartRank, pageEndRank, hasNextPage, nextCursor, candidates (an array in
    the order shown, with the keys of CANDIDATE but the made ones), and the structs componentPolicyVersions, diversitySummary and explorationSummary, written in the order
    of their fields. A null array of candidates is an empty page."""
    return bound(pages.withColumn("candidates", F.transform("candidates", seen)))


def bound(pages: DataFrame) -> DataFrame:
    """As build, of pages whose candidates are `seen` already: where candidates are rows, their texts are made there, by generated code, and not in an array by functions of its elements."""
    empty = F.array().cast(pages.schema["candidates"].dataType)
    rows = pages.withColumn("candidates", F.coalesce("candidates", empty))
    rows = rows.withColumn("refusal", F.coalesce(*(F.when(F.expr(c), name) for name, c in RULES)))
    good = F.col("refusal").isNull()
    made = {"schemaVersion": F.lit(SCHEMA), "cursorVersion": F.lit(CURSOR), "rankingStatus": F.col("status"), "rankingEmptyReason": F.col("emptyReason"), "pageCandidateCount": F.size("candidates")}
    of = rows.select(*(made.get(n, F.col(n)).alias(n) for n in _REPLAY + _PAGE if n not in ("replayKey", "candidates"))).schema
    texts = lambda names: {n: canonical(made.get(n, F.col(n)), of[n].dataType) for n in names}
    rows = rows.withColumn("replayKey", F.when(good, F.sha2(written(texts(_REPLAY)), 256)))
    told = {"replayKey": F.concat(F.lit('"'), F.col("replayKey"), F.lit('"'))} | texts(_PAGE[1:-1]) | {"candidates": listed(F.col("candidates.text"))}
    return rows.withColumn("pageFingerprint", F.when(good, F.sha2(written(told), 256)))


SHOWN = 5
_DIMENSIONS = ("duplicate_group", "author", "region", "theme")


def served_pages(d: Domain) -> DataFrame:
    """The first five lines of each order, as `seen`, with the order's counts; some pages break a rule."""
    item = F.col("rank").cast("int") + F.when((F.col("run_id") % 41 == 0) & (F.col("rank") > 2), 1).otherwise(0)
    score = F.when((F.col("discount") == 0) & (F.col("quantity") % 2 == 1), F.lit(-0.0)).otherwise(F.col("discount"))
    fields = {
        "entityId": F.when(F.col("run_id") % 37 == 0, "p").otherwise(F.concat(F.lit('p"'), F.col("post_id").cast("string"))), "entityType": F.lit("POST"), "absoluteRank": item, "origin": F.when(F.col("flag") == "R", EXPLORATION).otherwise(PERSONALIZED),
        "score": score, "baseAbsoluteRank": item, "diversifiedAbsoluteRank": item, "explorationQualityScore": F.when(F.col("run_id") % 31 == 0, 2.0).otherwise(F.col("quantity") / 50), "recentExposureCount": F.col("place_id"),
        "seededTieBreakKey": F.col("post_id"), "explorationPoolRank": item, "targetInsertionRank": item,
    }
    # what a page needs of a line is made in the line's own row
    one = d.runs.select("run_id", "user_id", "rank", "flag", F.struct(*(c.alias(k) for k, c in fields.items())).alias("c"))
    lines = one.select("run_id", "user_id", "flag", F.when(F.col("rank") <= SHOWN, F.struct("rank", seen(F.col("c"), F.col("rank") - 1).alias("c"))).alias("shown"))
    runs = lines.groupBy("run_id", "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("flag") == "R").alias("x"), F.sort_array(F.collect_list("shown")).alias("ordered"))
    run, n, x = F.col("run_id"), F.col("n").cast("int"), F.col("x").cast("int")
    left = (run % 3).cast("int")
    more = F.when(run % 47 == 0, n <= SHOWN).otherwise(n > SHOWN)
    zeros = F.struct(*(F.lit(0).alias(k) for k in _DIMENSIONS))
    given = {
        **{k: F.concat(F.lit(k[0]), run.cast("string")) for k in NAMES[:3]}, "userId": F.col("user_id").cast("string"), "contextId": F.when(run % 43 == 0, " ").otherwise("home"), **{k: F.lit("v1") for k in NAMES[5:10]}, "explorationSeed": F.concat(F.lit("s"), run.cast("string")),
        "rankingPolicyVersion": F.lit(RANKING), "status": F.lit("RANKED"), "emptyReason": F.lit(None).cast("string"), "requestedLimit": F.lit(None).cast("int"), "effectiveLimit": F.lit(SHOWN),
        "inputCount": n + left + F.when(run % 53 == 0, 1).otherwise(0), "scoredCount": n - x, "sourceTerminalCount": x + left, "personalizedCount": n - x, "insertedCount": x, "finalRankedCandidateCount": n, "terminalCandidateCount": left,
        "candidates": F.col("ordered.c"), "pageStartRank": F.lit(1), "pageEndRank": F.least(n, F.lit(SHOWN)) + F.when((run % 41 == 0) & (n > 2), 1).otherwise(0),
        "hasNextPage": more, "nextCursor": F.when(n > SHOWN, "next"), "componentPolicyVersions": F.struct(F.lit("c1").alias("context_match"), F.lit("i1").alias("interest_match"), F.lit("f1").alias("freshness"), F.lit("p1").alias("popularity")),
        "diversitySummary": F.struct(F.lit("APPLIED").alias("status"), x.alias("movedCandidateCount"), zeros.alias("violationCountByDimension")),
        "explorationSummary": F.struct(F.lit("APPLIED").alias("status"), x.alias("insertedCandidateCount"), F.array(F.lit(4), F.lit(9)).alias("insertedTargetRanks")),
    }
    return runs.select("run_id", *(c.alias(k) for k, c in given.items()))


_NUM = "CASE WHEN {0} = 0 THEN '0' ELSE regexp_replace(({0})::VARCHAR, '\\.0$', '') END"
_JSON = f"""'{{"entityId":"' || CASE WHEN run_id % 37 = 0 THEN 'p' ELSE 'p\\"' || post_id END || '","entityType":"POST","absoluteRank":' || item || ',"pagePosition":' || rank || ',"origin":"' || origin || '","score":' ||
    CASE WHEN own THEN {_NUM.format('discount')} ELSE 'null' END || ',"scoreIsNegativeZero":' || CASE WHEN own AND discount = 0 AND quantity % 2 = 1 THEN 'true' ELSE 'false' END || ',"baseAbsoluteRank":' || CASE WHEN own THEN item::VARCHAR ELSE 'null' END
    || ',"diversifiedAbsoluteRank":' || CASE WHEN own THEN item::VARCHAR ELSE 'null' END || ',"explorationQualityScore":' || CASE WHEN own THEN 'null' ELSE {_NUM.format('(quantity / 50)')} END || ',"recentExposureCount":' || CASE WHEN own THEN 'null' ELSE place_id::VARCHAR END
    || ',"seededTieBreakKey":' || CASE WHEN own THEN 'null' ELSE post_id::VARCHAR END || ',"explorationPoolRank":' || CASE WHEN own THEN 'null' ELSE item::VARCHAR END || ',"targetInsertionRank":' || CASE WHEN own THEN 'null' ELSE item::VARCHAR END || '}}'"""
_SQL = f"""WITH i AS (SELECT *, rank + CASE WHEN run_id % 41 = 0 AND rank > 2 THEN 1 ELSE 0 END AS item, CASE WHEN flag = 'R' THEN '{EXPLORATION}' ELSE '{PERSONALIZED}' END AS origin, flag IS DISTINCT FROM 'R' AS own FROM runs),
    g AS (SELECT run_id, user_id, count(*) AS n, count(*) FILTER (WHERE flag = 'R') AS x, count(*) FILTER (WHERE rank <= {SHOWN} AND flag = 'R') AS xs, count(DISTINCT CASE WHEN rank <= {SHOWN} THEN post_id END) AS ids, least(count(*), {SHOWN}) AS shown,
        string_agg({_JSON}, ',' ORDER BY rank) FILTER (WHERE rank <= {SHOWN}) AS candidates FROM i GROUP BY 1, 2),
    r AS (SELECT *, CASE WHEN run_id % 43 = 0 THEN 'NAME_BLANK' WHEN run_id % 53 = 0 THEN 'COUNT_INVARIANT' WHEN run_id % 41 = 0 AND n > 2 THEN 'RANK_DISCONTINUITY' WHEN run_id % 47 = 0 THEN 'NEXT_CURSOR'
        WHEN ids < shown OR (run_id % 37 = 0 AND shown > 1) THEN 'DUPLICATE_IDENTITY' WHEN run_id % 31 = 0 AND xs > 0 THEN 'EXPLORATION_CANDIDATE' END AS refusal,
        sha256('{{"schemaVersion":"{SCHEMA}","userId":"' || user_id || '","contextId":"home","cursorVersion":"{CURSOR}","rankingSnapshotId":"r' || run_id || '","metadataSnapshotId":"m' || run_id || '","explorationSnapshotId":"e' || run_id ||
        '","rankingPolicyVersion":"{RANKING}","baseIntegrationPolicyVersion":"v1","baseRankingPolicyVersion":"v1","scorePolicyVersion":"v1","componentPolicyVersions":{{"context_match":"c1","interest_match":"i1","freshness":"f1","popularity":"p1"}},"diversityPolicyVersion":"v1","explorationPolicyVersion":"v1","explorationSeed":"s' || run_id || '"}}') AS replay FROM g)
    SELECT run_id, refusal, shown::INTEGER AS n_candidates, CASE WHEN refusal IS NULL THEN replay END AS replay_key, CASE WHEN refusal IS NULL THEN sha256('{{"replayKey":"' || replay || '","rankingStatus":"RANKED","rankingEmptyReason":null,"requestedLimit":null,"effectiveLimit":{SHOWN},"pageStartRank":1,"pageEndRank":' || shown
        || ',"pageCandidateCount":' || shown || ',"hasNextPage":' || CASE WHEN n > {SHOWN} THEN 'true' ELSE 'false' END || ',"inputCount":' || (n + run_id % 3) || ',"finalRankedCandidateCount":' || n || ',"terminalCandidateCount":' || (run_id % 3)
        || ',"diversitySummary":{{"status":"APPLIED","movedCandidateCount":' || x || ',"violationCountByDimension":{{"duplicate_group":0,"author":0,"region":0,"theme":0}}}},"explorationSummary":{{"status":"APPLIED","insertedCandidateCount":' || x || ',"insertedTargetRanks":[4,9]}},"candidates":[' || candidates || ']}}') END AS page_fingerprint FROM r"""


@query("exposure_events", _SQL, ("runs",))
def exposure_events(d: Domain) -> DataFrame:
    """Each served page as an event's two digests, or the rule that it breaks."""
    return bound(served_pages(d)).select("run_id", "refusal", F.size("candidates").alias("n_candidates"), F.col("replayKey").alias("replay_key"), F.col("pageFingerprint").alias("page_fingerprint"))
