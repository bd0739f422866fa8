"""Mapping of behaviour events: one sound source, changed one field at a time."""

import hashlib
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.plans import adapters as a

VALUE = "struct<kind:string,text:string,number:double>"
SCHEMA = (
    "id string, event_ref string, key string, session string, wire string, schema string, body string, body_print string, occurred_at timestamp, received_at timestamp, user_id long, run string, "
    f"entity_type string, entity_key string, entity_id long, metadata array<struct<key:string,value:{VALUE}>>, subject string, exposure struct<ref:string,authority:string,run:string,entity_key:string,rank:int,position:int,surface:string>"
)
AT = datetime(2024, 1, 2, 3, 4, 5)
TEXT = lambda t: ("text", t, None)
NUMBER = lambda x: ("number", None, x)
EXPOSURE = ("exposure:9", a.AUTHORITY, "r1", "post:7", 3, 2, "home")


def source(**changes):
    body = changes.pop("body", "b")
    row = {
        "event_ref": "e1", "key": "k", "session": "s", "wire": "view", "schema": a.SCHEMA, "body": body, "body_print": None if body is None else hashlib.sha256(body.encode()).hexdigest(), "occurred_at": AT, "received_at": AT,
        "user_id": 5, "run": "r1", "entity_type": "post", "entity_key": "post:7", "entity_id": 7, "metadata": {"surface": TEXT("home")}, "subject": "subject:5", "exposure": None,
    }
    return row | changes


def of(kind, number, name=None):
    return {"entity_type": kind, "entity_key": f"{name or kind}:{number}", "entity_id": number}


NONE = {"entity_type": None, "entity_key": None, "entity_id": None}
MISSING, MISMATCH, UNMAPPABLE, CONTRACT, PRIVACY = "MISSING_REQUIRED_REFERENCE", "SOURCE_FINGERPRINT_MISMATCH", "PAYLOAD_UNMAPPABLE", "TARGET_CONTRACT_VIOLATION", "PRIVACY_POLICY_VIOLATION"
IDENTITY, UNEXPOSED, CONFLICT = "IDENTITY_MAPPING_REQUIRED", "MISSING_EXPOSURE_REFERENCE", "EXPOSURE_AUTHORITY_CONFLICT"
CLICK = {"wire": "click", "exposure": EXPOSURE}
SEARCH = {"wire": "search", **NONE}
CASES = [
    ({}, None),
    ({"event_ref": None}, MISSING), ({"event_ref": "-e"}, MISSING), ({"event_ref": "e" * 128}, None), ({"event_ref": "e" * 129}, MISSING), ({"event_ref": "e\n"}, MISSING),
    ({"key": " \t"}, MISSING), ({"key": "k" * 160}, None), ({"key": "k" * 161}, MISSING), ({"session": None}, MISSING), ({"session": "s" * 128}, None), ({"session": "s" * 129}, MISSING), ({"wire": ""}, MISSING),
    ({"body": ""}, MISMATCH), ({"body": None}, MISMATCH), ({"body": "é" * 131_072}, None), ({"body": "é" * 131_073}, MISMATCH), ({"body_print": "0" * 64}, MISMATCH), ({"body_print": None}, MISMATCH),
    ({"occurred_at": None}, "TIMESTAMP_INVALID"), ({"received_at": None}, "TIMESTAMP_INVALID"), ({"received_at": AT - timedelta(microseconds=1)}, "TIMESTAMP_INVALID"),
    ({"user_id": 0}, IDENTITY), ({"user_id": None}, IDENTITY), ({"subject": None}, IDENTITY), ({"schema": None}, "UNSUPPORTED_SCHEMA_VERSION"), ({"schema": "v2"}, "UNSUPPORTED_SCHEMA_VERSION"), ({"wire": "boost"}, "UNSUPPORTED_EVENT_TYPE"),
    # a source's own failures come before its schema's, that before the wire's, that before the subject's
    ({"schema": "v2", "user_id": -1}, IDENTITY), ({"schema": "v2", "wire": "boost"}, "UNSUPPORTED_SCHEMA_VERSION"), ({"wire": "boost", "subject": None}, "UNSUPPORTED_EVENT_TYPE"), ({"event_ref": None, "body": None}, MISSING),
    ({"metadata": {f"m{i}": NUMBER(1.0) for i in range(31)} | {"surface": TEXT("x")}}, None), ({"metadata": {f"m{i}": NUMBER(1.0) for i in range(32)} | {"surface": TEXT("x")}}, UNMAPPABLE),
    ({"metadata": {"a b": TEXT("x")}}, UNMAPPABLE), ({"metadata": {"User-Id": TEXT("x")}}, PRIVACY), ({"metadata": {"x.csrf_token": TEXT("x")}}, PRIVACY), ({"metadata": {"tokens": TEXT("x"), "surface": TEXT("x")}}, None),
    ({"metadata": {"a b": TEXT("x"), "token": TEXT("x")}}, UNMAPPABLE), ({"metadata": {"token": TEXT("x"), "a b": TEXT("x")}}, PRIVACY),
    ({"metadata": {"surface": ("list", None, None)}}, UNMAPPABLE), ({"metadata": {"surface": TEXT("x" * 256)}}, None), ({"metadata": {"surface": TEXT("x" * 257)}}, UNMAPPABLE),
    ({"metadata": {"surface": TEXT("x"), "n": NUMBER(float("nan"))}}, UNMAPPABLE), ({"metadata": {"surface": TEXT("x"), "n": NUMBER(float("-inf"))}}, UNMAPPABLE),
    ({"entity_id": None}, MISSING), (NONE, MISSING), (of("post", 0), MISSING), (of("post", 7, "place"), MISSING), (of("planet", 7), CONTRACT), (of("place", 7), MISSING), ({"wire": "search"}, CONTRACT),
    ({"metadata": {}}, UNMAPPABLE), ({"metadata": None}, UNMAPPABLE), ({"metadata": {"surface": TEXT(" ")}}, UNMAPPABLE), ({"metadata": {"surface": NUMBER(1.0)}}, UNMAPPABLE),
    (CLICK, None), (CLICK | {"exposure": None}, UNEXPOSED), (CLICK | {"exposure": EXPOSURE[:1] + ("recommendation_p2_experiment_exposure_v1",) + EXPOSURE[2:]}, CONFLICT), (CLICK | {"run": "r2"}, UNEXPOSED), (CLICK | {"run": None}, UNEXPOSED), (CLICK | of("post", 8), UNEXPOSED),
    (CLICK | {"metadata": {}}, None), (CLICK | {"metadata": {"surface": TEXT("crew")}}, CONFLICT), (CLICK | {"metadata": {"surface": NUMBER(1.0)}}, CONFLICT), (CLICK | {"metadata": {"position": NUMBER(2.9)}}, None), (CLICK | {"metadata": {"position": NUMBER(3.0)}}, CONFLICT),
    (CLICK | {"metadata": {"position": NUMBER(1e300)}}, CONFLICT), (CLICK | {"metadata": {"position": TEXT("9")}}, None), (CLICK | {"metadata": {}, "exposure": EXPOSURE[:6] + ("attic",)}, UNMAPPABLE),
    ({"wire": "like", "metadata": {}}, None), ({"wire": "follow"}, MISSING), ({"wire": "follow"} | of("user", 7), None), ({"wire": "crew_join"} | of("crew", 7), None),
    ({"wire": "share", "metadata": {"shareChannelClass": TEXT("direct_link")}}, None), ({"wire": "share", "metadata": {"shareChannelClass": TEXT("Direct")}}, UNMAPPABLE), ({"wire": "hide"}, UNMAPPABLE), ({"wire": "report", "metadata": {"reportReasonCode": TEXT("spam_")}}, UNMAPPABLE),
    (SEARCH | {"metadata": {"searchRunRef": TEXT("s1"), "queryRef": TEXT("q1")}}, None), (SEARCH | {"metadata": {"searchRunRef": TEXT("s1")}}, UNMAPPABLE), (SEARCH | {"metadata": {"searchRunRef": TEXT("s1"), "queryRef": TEXT("q1"), "surface": TEXT("attic")}}, UNMAPPABLE),
    ({"wire": "tag_click", "metadata": {"tagRef": TEXT("tag:sea"), "surface": TEXT("home")}}, None), ({"wire": "tag_click", "metadata": {"tagRef": TEXT("tag:"), "surface": TEXT("home")}}, MISSING),
    ({"wire": "tag_click", "metadata": {"tagRef": TEXT("post:7"), "surface": TEXT("home")}}, MISSING), ({"wire": "tag_click", "metadata": {"tagRef": TEXT("tag:sea")}}, UNMAPPABLE),
]


def adapted(spark, cases):
    names = [f.split()[0] for f in SCHEMA.split(", ") if " " in f]
    names = names[: names.index("metadata") + 1] + ["subject", "exposure"]
    rows = [{"id": str(i)} | source(**c) for i, c in enumerate(cases)]
    rows = [r | {"metadata": None if r["metadata"] is None else list(r["metadata"].items())} for r in rows]
    table = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA).withColumn("metadata", F.map_from_entries("metadata"))  # a dict would lose its order on the way
    found = {r["id"]: r for r in a.adapt(table, keep=("id",)).collect()}
    return [found[str(i)] for i in range(len(cases))]


def test_first_failures(spark):
    found = adapted(spark, [c for c, _ in CASES])
    assert [(c, r["failure"]) for (c, _), r in zip(CASES, found, strict=True)] == CASES
    for r in found:
        assert r["status"] == ("MAPPED_SHADOW" if r["failure"] is None else "QUARANTINED" if r["failure"] in a.QUARANTINED else "UNSUPPORTED")
        assert all((r[c] is None) == (r["failure"] is not None) for c in ("target", "actor", "session_ref", "payload", "dropped", "output_print"))


def test_mapped_events(spark):
    like, click, tag, search, moved = adapted(
        spark,
        [
            {"wire": "like", "metadata": {"zeta": TEXT("x"), "viewportRatio": NUMBER(0.5), "alpha": TEXT("x")}, "run": None},
            CLICK | {"metadata": {"surface": TEXT("home"), "position": NUMBER(2.0)}},
            {"wire": "tag_click", "metadata": {"tagRef": TEXT('tag:"sea"'), "surface": TEXT("crew")}},
            SEARCH | {"metadata": {"searchRunRef": TEXT("s1"), "queryRef": TEXT("q1")}},
            {"wire": "like", "metadata": {}, "run": None, "session": "t"},
        ],
    )
    assert (like["target"], like["payload"], like["dropped"], like["run_ref"], like["entity"]) == ("post_like", '{"stateTransitionRef":"recommendation_behavior_event:e1"}', "alpha,zeta", None, "post:7")
    assert like["session_ref"] == "session:p0-" + hashlib.sha256(b"s").hexdigest()
    assert (click["payload"], click["authority"]) == ('{"absoluteRank":3,"runRef":"recommendation_run:r1","surface":"home"}', "exposure:9")
    assert (tag["entity"], tag["payload"]) == ('tag:"sea"', '{"surface":"crew","tagRef":"tag:\\"sea\\""}')
    assert (search["entity"], search["payload"], search["authority"]) == (None, '{"queryRef":"q1","searchRunRef":"s1"}', None)
    assert like["output_print"] != moved["output_print"]


def test_binding_keeps_every_source(spark):
    rows = spark.createDataFrame([("a", 1, "post:1"), ("b", None, None), ("c", 2, "post:9")], "id string, user_id long, entity_key string")
    bound = a.bind(rows, spark.createDataFrame([(1, "subject:1")], "user_id long, subject string"), spark.createDataFrame([("post:9", "x")], "entity_key string, exposure string"))
    assert sorted((r["id"], r["subject"], r["exposure"]) for r in bound.collect()) == [("a", "subject:1", None), ("b", None, None), ("c", None, "x")]
