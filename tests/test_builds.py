"""Canonical JSON against a writer in Python, and pages that break each rule."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions.canonical import canonical, negative_zero, number
from tidemark.plans import builds as b
from tidemark.sources.tables import Domain

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_numbers(spark):
    values = [(0.0, "0"), (-0.0, "0"), (1.0, "1"), (-2.0, "-2"), (0.1, "0.1"), (1e-7, "1e-7"), (1.5e-10, "1.5e-10"), (1e21, "1e21"), (123456789.5, "1.234567895e8"), (float("nan"), None), (float("inf"), None), (None, None)]
    df = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(values)], "i int, v double, t string")
    for r in df.select("v", "t", number(F.col("v")).alias("got"), negative_zero(F.col("v")).alias("zero")).collect():
        assert r["got"] == r["t"], r
        assert bool(r["zero"]) == (str(r["v"]) == "-0.0")


def test_nested_text(spark):
    texts = ["plain", 'q"uo\\te', "line\nend\ttab\r", "\x01\x1f\b\f", "한글 𝄞", "", None]
    rows = [(i, t, [(t, i % 2 == 0), (None, None)], None if i == 2 else []) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, s string, items array<struct<name: string, on: boolean>>, none array<bigint>")
    whole = F.struct("s", "i", "items", "none")
    of = df.select(whole.alias("w")).schema["w"].dataType
    got = {r["i"]: r["j"] for r in df.select("i", canonical(whole, of).alias("j")).collect()}
    for i, s, items, none in rows:
        assert got[i] == json.dumps({"s": s, "i": i, "items": [{"name": n, "on": o} for n, o in items], "none": none}, separators=(",", ":"), ensure_ascii=False)
    assert spark.range(1).select(canonical(F.array(F.lit(1.0), F.lit(float("nan"))), df.select(F.array(F.lit(1.0)).alias("a")).schema["a"].dataType).alias("x")).first()["x"] is None


def page(spark, candidates="default", **changed):
    one = lambda r, o, score="0.5", id_="x": (
        f"named_struct('entityId', '{id_}{r}', 'entityType', 'POST', 'absoluteRank', {r}, 'origin', '{o}', 'score', cast({score} as double), 'baseAbsoluteRank', {r}, 'diversifiedAbsoluteRank', {r}, 'explorationQualityScore', 0.75D, "
        f"'recentExposureCount', 3L, 'seededTieBreakKey', 9L, 'explorationPoolRank', 1, 'targetInsertionRank', 2)"
    )
    given = {
        **{n: f"'{n[0]}'" for n in b.NAMES}, "rankingPolicyVersion": f"'{b.RANKING}'", "status": "'RANKED'", "emptyReason": "cast(null as string)", "requestedLimit": "cast(null as int)", "effectiveLimit": "2", "inputCount": "4", "scoredCount": "2",
        "sourceTerminalCount": "2", "personalizedCount": "2", "insertedCount": "1", "finalRankedCandidateCount": "3", "terminalCandidateCount": "1", "pageStartRank": "1", "pageEndRank": "2", "hasNextPage": "true", "nextCursor": "'c'",
        "componentPolicyVersions": "named_struct('a', 'b')", "diversitySummary": "named_struct('n', 1)", "explorationSummary": "named_struct('r', array(2))",
        "candidates": f"array({one(1, b.PERSONALIZED, '-0.0D')}, {one(2, b.EXPLORATION)})" if candidates == "default" else candidates(one),
    } | changed
    return spark.sql("select " + ", ".join(f"{v} as {k}" for k, v in given.items()))


def test_a_page_by_hand(spark):
    r = b.build(page(spark)).first()
    replay = {"schemaVersion": b.SCHEMA, "userId": "u", "contextId": "c", "cursorVersion": b.CURSOR, "rankingSnapshotId": "r", "metadataSnapshotId": "m", "explorationSnapshotId": "e", "rankingPolicyVersion": b.RANKING}
    replay |= {"baseIntegrationPolicyVersion": "b", "baseRankingPolicyVersion": "b", "scorePolicyVersion": "s", "componentPolicyVersions": {"a": "b"}, "diversityPolicyVersion": "d", "explorationPolicyVersion": "e", "explorationSeed": "e"}
    sha = lambda x: hashlib.sha256(json.dumps(x, separators=(",", ":")).encode()).hexdigest()
    assert r["refusal"] is None and r["replayKey"] == sha(replay)
    keys = [k for k, _ in b.CANDIDATE]
    shown = [dict(zip(keys, v)) for v in (["x1", "POST", 1, 1, b.PERSONALIZED, 0, True, 1, 1, None, None, None, None, None], ["x2", "POST", 2, 2, b.EXPLORATION, None, False, None, None, 0.75, 3, 9, 1, 2])]
    content = {"replayKey": r["replayKey"], "rankingStatus": "RANKED", "rankingEmptyReason": None, "requestedLimit": None, "effectiveLimit": 2, "pageStartRank": 1, "pageEndRank": 2, "pageCandidateCount": 2, "hasNextPage": True}
    content |= {"inputCount": 4, "finalRankedCandidateCount": 3, "terminalCandidateCount": 1, "diversitySummary": {"n": 1}, "explorationSummary": {"r": [2]}, "candidates": shown}
    assert r["pageFingerprint"] == sha(content)
    positive = b.build(page(spark, lambda one: f"array({one(1, b.PERSONALIZED, '0.0D')}, {one(2, b.EXPLORATION)})")).first()
    assert positive["replayKey"] == r["replayKey"] and positive["pageFingerprint"] != r["pageFingerprint"]  # the zero's sign is told


NO_PAGE = {"pageStartRank": "cast(null as int)", "pageEndRank": "cast(null as int)", "hasNextPage": "false", "nextCursor": "cast(null as string)"}
EMPTY = lambda one: f"slice(array({one(1, 'x')}), 1, 0)"
TWO = lambda *specs: lambda one: "array(" + ", ".join(one(*s) for s in specs) + ")"
P, X = b.PERSONALIZED, b.EXPLORATION


@pytest.mark.parametrize(
    "refusal, candidates, changed",
    [
        ("RANKING_POLICY", "default", {"rankingPolicyVersion": "cast(null as string)"}), ("NAME_BLANK", "default", {"userId": "' '"}), ("NAME_BLANK", "default", {"contextId": "cast(null as string)"}), ("SEED_TOO_LONG", "default", {"explorationSeed": "repeat('é', 65)"}),
        (None, "default", {"explorationSeed": "repeat('é', 64)"}), ("COUNT_NEGATIVE", "default", {"insertedCount": "-1"}), ("COUNT_INVARIANT", "default", {"inputCount": "5"}), ("PAGE_LIMIT", "default", {"effectiveLimit": "1"}), ("PAGE_LIMIT", "default", {"effectiveLimit": "101"}),
        ("PAGE_LIMIT", "default", {"requestedLimit": "0"}), ("EMPTY_PAGE", EMPTY, {}), (None, EMPTY, NO_PAGE), ("EMPTY_RESULT", EMPTY, NO_PAGE | {"status": "'EMPTY'"}), ("PAGE_RANK_BOUNDARY", "default", {"pageEndRank": "3"}), ("RANK_DISCONTINUITY", TWO((1, P), (3, P)), {"pageEndRank": "3"}),
        ("NEXT_CURSOR", "default", {"nextCursor": "cast(null as string)"}), ("DUPLICATE_IDENTITY", lambda one: f"array({one(1, P)}, {one(2, P)!s})".replace("'x2'", "'x1'"), {}), ("RANK_BEYOND_FINAL", TWO((3, P), (4, P)), {"pageStartRank": "3", "pageEndRank": "4"}),
        ("PERSONALIZED_CANDIDATE", TWO((1, P, "1.5D"), (2, P)), {}), ("PERSONALIZED_CANDIDATE", TWO((1, P, "'NaN'"), (2, P)), {}), ("PERSONALIZED_CANDIDATE", TWO((1, P, "null"), (2, P)), {}), ("UNSUPPORTED_ORIGIN", TWO((1, P), (2, "OTHER")), {}),
        ("EXPLORATION_CANDIDATE", lambda one: f"array({one(1, P)}, {one(2, X)})".replace("9L", "4294967296L"), {}),
    ],
)
def test_rules(spark, refusal, candidates, changed):
    r = b.build(page(spark, candidates, **changed)).first()
    assert r["refusal"] == refusal and (r["replayKey"] is None) == (r["pageFingerprint"] is None) == (refusal is not None)


def test_no_pages_and_null_candidates(spark):
    assert b.build(page(spark).limit(0)).count() == 0
    none = page(spark, **NO_PAGE).withColumn("candidates", F.when(F.lit(False), F.col("candidates")))
    assert b.build(none).first()["refusal"] is None


def test_candidates_seen_as_rows_give_the_same_event(spark):
    """A page whose candidates were made ready in rows of their own is bound as one built from the array, and exposure_events makes them so."""
    pages = page(spark).unionByName(page(spark, TWO((1, P, "1.5D"), (2, P)))).unionByName(page(spark, TWO((1, P), (3, P)), pageEndRank="3")).withColumn("page", F.monotonically_increasing_id())
    rows = pages.select("page", F.posexplode("candidates").alias("at", "c")).select("page", F.struct("at", b.seen(F.col("c"), F.col("at")).alias("c")).alias("one"))
    ready = pages.drop("candidates").join(rows.groupBy("page").agg(F.sort_array(F.collect_list("one")).alias("ones")), "page").withColumn("candidates", F.col("ones.c"))
    got, want = ({r["page"]: (r["refusal"], r["replayKey"], r["pageFingerprint"]) for r in x.collect()} for x in (b.bound(ready), b.build(pages)))
    assert got == want and [refusal for refusal, _, _ in sorted(got.values(), key=str)] == ["PERSONALIZED_CANDIDATE", "RANK_DISCONTINUITY", None]
    if os.path.isdir(DIR):
        assert b.served_pages(Domain(spark, DIR)).schema["candidates"].dataType.elementType.names == ["absoluteRank", "identity", "fault", "text"]
