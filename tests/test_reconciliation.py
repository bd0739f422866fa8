"""Reconciliation of cases by hand, and the normal forms they are compared in."""

import hashlib

from pyspark.sql import functions as F

from tidemark.plans import reconciliation as r

GOOD = f"named_struct('status', 'VALID', 'deleted', false, 'valid_until', timestamp'2024-02-02', 'purpose', '{r.PURPOSE}', 'caller', '{r.CALLER}', 'subject', 'synthetic-subject:1', 'user', 'synthetic-user:1')"
SIDE = "named_struct('exact', map('user', '1'), 'counts', {counts}, 'windows', map('7d:click', 1), 'checkpoint', 'cp', 'sequence', {sequence}, 'recorded_at', {at}, 'lineage', {lineage}{more})"
MORE = ", 'max_staleness', 60, 'ordering', false, 'event_grain', true, 'preferences', cast(null as boolean), 'transform', true"


def case(name, identity=GOOD, counts="map('click', 2, 'save', 1)", sequence="5", at="timestamp'2024-02-01' - interval 59 seconds", lineage="'l'"):
    fixed = {"counts": "map('save', 1, 'click', 2)", "sequence": "5", "at": "timestamp'2024-01-01'", "lineage": "'l'"}
    return f"select '{name}' as case_id, {SIDE.format(**fixed, more='')} as reference, {SIDE.format(counts=counts, sequence=sequence, at=at, lineage=lineage, more=MORE)} as candidate, {identity} as identity, timestamp'2024-02-01' as at"


def test_profiles(spark):
    cases = [
        case("same"), case("counts", counts="map('click', 2)"), case("null counts", counts="cast(null as map<string, int>)"), case("sequence", sequence="6"), case("old", at="timestamp'2024-02-01' - interval 60 seconds"),
        case("later", at="timestamp'2024-02-01 00:00:01'"), case("never", at="cast(null as timestamp)"), case("lineage", lineage="cast(null as string)"), case("deleted", GOOD.replace("false", "true")), case("expired", GOOD.replace("02-02", "02-01")),
        case("status", GOOD.replace("'VALID'", "cast(null as string)")), case("scheme", GOOD.replace("synthetic-user:1", "user:1")), case("caller", GOOD.replace(r.CALLER, "x")),
    ]
    df = r.reconcile(spark.sql(" union all ".join(cases)), r.profile_dimensions())
    got = {x["case_id"]: x for x in df.collect()}
    wrong = {k: [(d["dimension"], d["classification"]) for d in x["dimensions"] if d["blocking"]] for k, x in got.items()}
    checkpoint, identity = "SOURCE_CHECKPOINT_PARITY", "IDENTITY_BLOCKED"
    assert wrong == {
        "same": [], "counts": [("DERIVED_VALUE_PARITY", "RECONCILIATION_INCONCLUSIVE")], "null counts": [("DERIVED_VALUE_PARITY", "RECONCILIATION_INCONCLUSIVE")], "sequence": [(checkpoint, "SOURCE_CHECKPOINT_MISMATCH")],
        "old": [(checkpoint, "SOURCE_STALE")], "later": [(checkpoint, "SOURCE_STALE")], "never": [(checkpoint, "SOURCE_STALE")], "lineage": [("SOURCE_LINEAGE_PARITY", "LINEAGE_MISMATCH")],
        "deleted": [(identity, "IDENTITY_MAPPING_REQUIRED")], "expired": [(identity, "IDENTITY_MAPPING_REQUIRED")], "status": [(identity, "IDENTITY_MAPPING_REQUIRED")], "scheme": [(identity, "IDENTITY_SCHEME_MISMATCH")],
        "caller": [(identity, "IDENTITY_MAPPING_REQUIRED")],
    }
    assert {k: x["verdict"] for k, x in got.items() if x["verdict"] != "BLOCKED_BY_UNEXPECTED_MISMATCH"} == {"same": "RECONCILED_WITH_EXPECTED_GAPS"} | dict.fromkeys(("deleted", "expired", "status", "scheme", "caller"), "BLOCKED_BY_IDENTITY")
    gaps = {d["dimension"]: d["classification"] for d in got["same"]["dimensions"]}
    assert len(gaps) == 11 and gaps["EVENT_GRAIN_MISSING"] == "MATCH_EXACT" and gaps["EXPLICIT_PREFERENCE_MISSING"] == gaps["ORDERING_NOT_COMPARABLE"] == "EXPECTED_SEMANTIC_GAP"


def test_normal_forms(spark):
    row = spark.range(1).select(
        r.normal_map(F.expr(r"map('b', 'x,y', 'a=1', '[z]', 'n', null)")).alias("m"), r.normal_map(F.expr("cast(null as map<string, string>)")).alias("none"),
        r.normal_set(F.expr("array('save', 'click', 'save')")).alias("s"), r.safe(F.lit("synthetic-run:7")).alias("run"), r.safe(F.lit(" \t")).alias("blank"), r.safe(F.lit("a\r\nb\rc")).alias("lines"),
    ).first()
    assert row["m"] == r"{a\=1=\[z\],b=x\,y,n=null}" and row["none"] == "{}" and row["s"] == "[click,save]"
    assert row["run"] == "sha256:" + hashlib.sha256(b"synthetic-run:7").hexdigest() and row["blank"] == "<empty>" and row["lines"] == "a\nb\nc"
