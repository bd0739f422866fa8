"""Shadow reconciliation: what is recorded against what a candidate projection says, one row per case and dimension, and a verdict per case.

Profile cases are members, whose counts are recorded from all behaviour and projected without what the projection hasn't seen; experiment cases
are orders, recorded from their lines and projected from most of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import NOW, Domain, now
from .registry import query

# The purpose and caller that an identity is bound for, the authority and kind of exposures, the window's seconds, events that are engagement.
PURPOSE, CALLER = "RCA1_OFFLINE_RECONCILIATION_ONLY", "rca1-fixture-runner"
AUTHORITY, EXPOSURE_KIND, WINDOW_SECONDS = "recommendation_p2_experiment_exposure", "p2_experiment_exposure", 604_800
ENGAGEMENT = ("click", "like", "save", "share")
# What may be wrong with an identity, in order; (condition, classification, status).
IDENTITY = (
    ("identity.status = 'MISMATCHED'", "IDENTITY_SCHEME_MISMATCH", "'MISMATCHED'"),
    ("not (identity.status <=> 'VALID')", "IDENTITY_MAPPING_REQUIRED", "coalesce(identity.status, 'ABSENT')"),
    ("identity.deleted", "IDENTITY_MAPPING_REQUIRED", "'DELETED'"),
    ("not coalesce(identity.valid_until > at, false)", "IDENTITY_MAPPING_REQUIRED", "'EXPIRED'"),
    (f"not (identity.purpose <=> '{PURPOSE}')", "IDENTITY_MAPPING_REQUIRED", "'UNAUTHORIZED_PURPOSE'"),
    (f"not (identity.caller <=> '{CALLER}')", "IDENTITY_MAPPING_REQUIRED", "'UNAUTHORIZED_CALLER'"),
    ("not coalesce(identity.subject like 'synthetic-subject:%' and identity.user like 'synthetic-user:%', false)", "IDENTITY_SCHEME_MISMATCH", "'INVALID_SCHEME'"),
)
SENSITIVE = ("synthetic-subject:", "synthetic-user:", "synthetic-session:", "synthetic-run:")


def escaped(text: Column) -> Column:
    """Signs of the normal form behind a backslash; line ends as one line feed."""
    return F.regexp_replace(F.regexp_replace(text, r"([\\,=\[\]{}])", r"\\$1"), r"\r\n|\r", "\n")


def normal_map(m: Column) -> Column:
    """{key=value,...} by key; null as the empty map."""
    pairs = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].cast("string").alias("k"), F.coalesce(e["value"].cast("string"), F.lit("null")).alias("v")))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda e: F.concat(escaped(e["k"]), F.lit("="), escaped(e["v"]))), ","), F.lit("")), F.lit("}"))


def normal_set(values: Column) -> Column:
    """[value,...] in order, each once; null as the empty set."""
    return F.concat(F.lit("["), F.coalesce(F.array_join(F.transform(F.array_sort(F.array_distinct(values)), escaped), ","), F.lit("")), F.lit("]"))


def safe(text: Column) -> Column:
    """Blank as <empty>, references to persons as their digest."""
    blank = text.isNull() | ~text.rlike(r"\S")
    return F.when(blank, "<empty>").when(text.rlike("^(" + "|".join(SENSITIVE) + ")"), F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(escaped(text))


def _row(dimension: str, same, match: str, mismatch: str | Column, expected: Column, actual: Column, blocks: bool = True) -> Column:
    """A dimension whose two sides must be the same; where they may differ, blocks is False."""
    same = F.coalesce(same, F.lit(False))
    other = F.lit(mismatch) if isinstance(mismatch, str) else mismatch
    return F.struct(
        F.lit(dimension).alias("dimension"), F.when(same, match).otherwise(other).alias("classification"), F.coalesce(expected, F.lit("<empty>")).alias("expected"),
        F.coalesce(actual, F.lit("<empty>")).alias("actual"), (~same & F.lit(blocks)).alias("blocking"),
    )


def _identity() -> Column:
    broken = [F.expr(c) for c, *_ in IDENTITY]
    kind = F.coalesce(*(F.when(b, c) for b, (_, c, _) in zip(broken, IDENTITY)))
    status = F.coalesce(*(F.when(b, F.expr(s)) for b, (*_, s) in zip(broken, IDENTITY)), F.lit("VALID"))
    return _row("IDENTITY_BLOCKED", kind.isNull(), "MATCH_EXACT", kind, F.lit("synthetic-binding-valid"), status)


def _checkpoint() -> Column:
    """The same reference and number, and neither older than its limit nor from later on."""
    text = lambda side: escaped(F.concat_ws("|", *(F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("")) for c in ("checkpoint", "sequence")), F.coalesce(F.unix_seconds(f"{side}.recorded_at").cast("string"), F.lit(""))))
    same = F.col("reference.checkpoint").eqNullSafe(F.col("candidate.checkpoint")) & F.col("reference.sequence").eqNullSafe(F.col("candidate.sequence"))
    age = F.unix_seconds("at") - F.unix_seconds("candidate.recorded_at")
    fresh = F.coalesce((age >= 0) & (age < F.col("candidate.max_staleness")), F.lit(False))
    return _row("SOURCE_CHECKPOINT_PARITY", same & fresh, "MATCH_EXACT", F.when(same, "SOURCE_STALE").otherwise("SOURCE_CHECKPOINT_MISMATCH"), text("reference"), text("candidate"))


def _lineage() -> Column:
    e, a = F.col("reference.lineage"), F.col("candidate.lineage")
    return _row("SOURCE_LINEAGE_PARITY", e.eqNullSafe(a), "MATCH_EXACT", "LINEAGE_MISMATCH", e, a)


def _equal(dimension: str, expected: Column, actual: Column, match: str = "MATCH_EXACT", mismatch: str | Column = "RECONCILIATION_INCONCLUSIVE") -> Column:
    return _row(dimension, expected.eqNullSafe(actual), match, mismatch, expected, actual)


def _lacking(dimension: str, lacks: Column, classification: str, has: str, hasnt: tuple[str, str]) -> Column:
    return _row(dimension, ~lacks, "MATCH_EXACT", classification, F.when(lacks, hasnt[0]).otherwise(has), F.when(lacks, hasnt[1]).otherwise(has), blocks=False)


def _protected(dimension: str, expected: str, actual: str) -> Column:
    return _row(dimension, F.lit(False), "", "PROTECTED_AUTHORITY_DIFFERENCE", F.lit(expected), F.lit(actual), blocks=False)


def profile_dimensions() -> Column:
    """Eleven dimensions of a profile case as an array. reference: exact, counts, windows (maps), checkpoint, sequence, recorded_at, lineage; candidate: the same,
    max_staleness, and ordering, event_grain, preferences, transform (whether it has them)."""
    rows = [_identity()]
    for dimension, field, match in (("EXACT_FIELD_PARITY", "exact", "MATCH_EXACT"), ("DERIVED_VALUE_PARITY", "counts", "MATCH_DERIVED"), ("AGGREGATE_WINDOW_PARITY", "windows", "MATCH_EXACT")):
        rows.append(_equal(dimension, normal_map(F.col(f"reference.{field}")), normal_map(F.col(f"candidate.{field}")), match))
    rows += [_checkpoint(), _lineage()]
    for dimension, field in (("ORDERING_NOT_COMPARABLE", "ordering"), ("EVENT_GRAIN_MISSING", "event_grain"), ("EXPLICIT_PREFERENCE_MISSING", "preferences"), ("TRANSFORM_POLICY_MISSING", "transform")):
        rows.append(_lacking(dimension, ~F.coalesce(F.col(f"candidate.{field}"), F.lit(False)), "EXPECTED_SEMANTIC_GAP", "available", ("authoritative-only", "candidate-missing")))
    return F.array(*rows, _protected("FINGERPRINT_SEMANTICS_PROTECTED", "protected-profile-fingerprint", "candidate-projection-fingerprint"))


def experiment_dimensions() -> Column:
    """Thirteen dimensions of an experiment case as an array. reference: experiment, version, variant, subject, session, run, exposure, window_seconds, events (array),
    fallback, checkpoint, sequence, recorded_at, lineage; candidate: the same, max_staleness, authority, kind, fallback_run, stale_gap, dedupe_gap."""
    r, c = (lambda x: F.col(f"reference.{x}")), (lambda x: F.col(f"candidate.{x}"))
    joined = lambda side, *names: F.concat_ws("|", *(F.coalesce(side(n).cast("string"), F.lit("")) for n in names))
    bound = lambda side: F.concat(F.lit("sha256:"), F.sha2(joined(side, "subject", "session", "run", "exposure"), 256))
    who = F.when(r("subject").eqNullSafe(c("subject")), "RECONCILIATION_INCONCLUSIVE").otherwise("IDENTITY_SCHEME_MISMATCH")
    shown = c("authority").eqNullSafe(F.lit(AUTHORITY)) & c("kind").eqNullSafe(F.lit(EXPOSURE_KIND)) & r("exposure").eqNullSafe(c("exposure"))
    windows = r("window_seconds").eqNullSafe(F.lit(WINDOW_SECONDS)) & c("window_seconds").eqNullSafe(F.lit(WINDOW_SECONDS))
    allowed = F.size(F.array_except(F.coalesce(c("events"), F.array().cast("array<string>")), F.array(*map(F.lit, ENGAGEMENT)))) == 0
    tied = ~F.coalesce(c("fallback"), F.lit(False)) | (F.coalesce(r("fallback"), F.lit(False)) & r("run").eqNullSafe(c("fallback_run")))
    gap = lambda x: F.coalesce(c(x), F.lit(False))
    return F.array(
        _identity(),
        _equal("ASSIGNMENT_PARITY", safe(joined(r, "experiment", "version", "variant")), safe(joined(c, "experiment", "version", "variant"))),
        _equal("SUBJECT_SESSION_RUN_PARITY", bound(r), bound(c), mismatch=who),
        _row("EXPOSURE_REFERENCE_PARITY", shown, "MATCH_EXACT", "EXPOSURE_AUTHORITY_MISMATCH", safe(F.concat(F.lit(AUTHORITY + "|"), F.coalesce(r("exposure"), F.lit("")))), safe(joined(c, "authority", "exposure"))),
        _row("OUTCOME_WINDOW_PARITY", windows, "MATCH_EXACT", "OUTCOME_WINDOW_MISMATCH", F.lit(str(WINDOW_SECONDS)), c("window_seconds").cast("string")),
        _row("ENGAGEMENT_EVENT_PARITY", allowed & (normal_set(r("events")) == normal_set(c("events"))), "MATCH_EXACT", "PROTECTED_AUTHORITY_DIFFERENCE", normal_set(r("events")), normal_set(c("events"))),
        _row("FALLBACK_BINDING_PARITY", tied, "MATCH_EXACT", "FALLBACK_BINDING_MISMATCH", safe(r("run")), safe(c("fallback_run"))),
        _lacking("STALE_UNEXPOSED_ASSIGNMENT_GAP", gap("stale_gap"), "MIGRATION_REQUIRED", "no-gap", ("no-gap", "migration-gap")),
        _lacking("OBSERVATION_DEDUPE_GAP", gap("dedupe_gap"), "MIGRATION_REQUIRED", "no-gap", ("no-gap", "migration-gap")),
        _protected("CANONICAL_DATASET_HASH_PROTECTED", "protected-canonical-hash", "not-read-or-recalculated"),
        _protected("RELEASE_EVIDENCE_PROTECTED", "protected-release-evidence", "not-read-or-modified"),
        _checkpoint(),
        _lineage(),
    )


def verdict(rows: Column) -> Column:
    """The worst that a case's dimensions say: identity before other mismatches before migrations."""
    identity = F.exists(rows, lambda x: ((x["dimension"] == "IDENTITY_BLOCKED") & x["blocking"]) | ((x["dimension"] == "SUBJECT_SESSION_RUN_PARITY") & (x["classification"] == "IDENTITY_SCHEME_MISMATCH")))
    out = F.when(identity, "BLOCKED_BY_IDENTITY").when(F.exists(rows, lambda x: x["blocking"]), "BLOCKED_BY_UNEXPECTED_MISMATCH")
    return out.when(F.exists(rows, lambda x: x["classification"] == "MIGRATION_REQUIRED"), "RECONCILED_WITH_MIGRATION_GAPS").otherwise("RECONCILED_WITH_EXPECTED_GAPS")


def reconcile(cases: DataFrame, dimensions: Column) -> DataFrame:
    """Adds dimensions (an array) and verdict to cases of (case_id, reference, candidate, identity, at): all within the row, without a shuffle."""
    return cases.select("case_id", dimensions.alias("dimensions")).withColumn("verdict", verdict(F.col("dimensions")))


_WINDOWS = (7, 30, 90)
_STATUS = "CASE WHEN {0} % 23 = 0 THEN 'MISMATCHED' WHEN {0} % 29 = 0 THEN 'ABSENT' ELSE 'VALID' END"
_BOUND = {
    "status": _STATUS, "deleted": "{0} % 31 = 0", "valid_until": f"CASE WHEN {{0}} % 37 = 0 THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{NOW}' + INTERVAL 1 DAY END",
    "purpose": f"CASE WHEN {{0}} % 41 = 0 THEN 'OTHER' ELSE '{PURPOSE}' END", "caller": f"CASE WHEN {{0}} % 43 = 0 THEN 'other' ELSE '{CALLER}' END",
    "subject": "concat('synthetic-subject:', {0})", "user": "CASE WHEN {0} % 47 = 0 THEN concat('user:', {0}) ELSE concat('synthetic-user:', {0}) END",
}


def _bound(key: str) -> Column:
    return F.struct(*(F.expr(v.format(key)).alias(k) for k, v in _BOUND.items()))


def profile_cases(d: Domain) -> DataFrame:
    """Members: behaviour folded to (member, kind) once for both sides; the candidate lacks rows that its projection hasn't seen."""
    rows = d.behaviour.withColumns({"seen": F.col("event_id") % 401 != 0, "age": F.unix_seconds(now()) - F.unix_seconds("ts")})
    seen = lambda c: F.when(F.col("seen"), c)
    folded = rows.groupBy("user_id", "kind").agg(
        F.count("*").alias("n0"), F.count_if("seen").alias("m0"), *(F.count_if(F.col("age") < w * 86400).alias(f"n{w}") for w in _WINDOWS), *(F.count_if(F.col("seen") & (F.col("age") < w * 86400)).alias(f"m{w}") for w in _WINDOWS),
        F.max("event_id").alias("last"), F.max(seen(F.col("event_id"))).alias("seen_last"), F.max("ts").alias("ts"), F.max(seen(F.col("ts"))).alias("seen_ts"),
    )
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))

    def maps(side: str) -> dict[str, Column]:
        windows = F.flatten(F.collect_list(F.array(*(entry(F.concat(F.lit(f"{w}d:"), F.col("kind")), F.col(f"{side}{w}")) for w in _WINDOWS))))
        counts = F.collect_list(F.when(F.col(f"{side}0") > 0, entry(F.col("kind"), F.col(f"{side}0"))))
        return {f"{side}_counts": F.map_from_entries(counts), f"{side}_windows": F.map_from_entries(F.filter(windows, lambda e: e["v"] > 0))}

    each = folded.groupBy("user_id").agg(*(c.alias(k) for side in "nm" for k, c in maps(side).items()), *(F.max(c).alias(c) for c in ("last", "seen_last", "ts", "seen_ts")))
    key = F.col("user_id")
    exact = lambda schema: F.create_map(F.lit("user"), key.cast("string"), F.lit("schema"), schema)
    reference = F.struct(
        exact(F.lit("v1")).alias("exact"), F.col("n_counts").alias("counts"), F.col("n_windows").alias("windows"), F.lit("behaviour").alias("checkpoint"), F.col("last").alias("sequence"),
        F.col("ts").alias("recorded_at"), F.concat(F.lit("l"), key.cast("string")).alias("lineage"),
    )
    candidate = F.struct(
        exact(F.when(key % 17 == 0, "v{0}").otherwise("v1")).alias("exact"), F.col("m_counts").alias("counts"), F.col("m_windows").alias("windows"), F.lit("behaviour").alias("checkpoint"),
        F.col("seen_last").alias("sequence"), F.col("seen_ts").alias("recorded_at"), F.lit(10 * 86400).alias("max_staleness"), F.concat(F.when(key % 19 == 0, "x").otherwise("l"), key.cast("string")).alias("lineage"),
        F.lit(False).alias("ordering"), F.lit(False).alias("event_grain"), (key % 2 == 0).alias("preferences"), F.lit(False).alias("transform"),
    )
    return each.select(key.alias("case_id"), reference.alias("reference"), candidate.alias("candidate"), _bound("user_id").alias("identity"), now().alias("at"))


def experiment_cases(d: Domain) -> DataFrame:
    """Orders: their lines' kinds are folded once, to the recorded set and the one that the candidate has."""
    kind = F.when(F.col("l_returnflag") == "A", "click").when(F.col("l_returnflag") == "R", "save").when(F.col("l_partkey") % 2 == 0, "like").otherwise("share")
    told = F.when((F.col("l_linenumber") == 3) & (F.col("l_partkey") % 97 == 0), "view").when(F.col("l_partkey") % 101 != 0, kind)
    sets = d.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(kind).alias("events"), F.collect_set(told).alias("told"))
    rows = d.table("orders").join(sets, "o_orderkey", "left")
    key, text = F.col("o_orderkey"), (lambda head, c: F.concat(F.lit(head), F.col(c).cast("string")))
    recorded = F.timestamp_micros(F.unix_micros(now()) - (key % 50) * 3_600_000_000)

    def side(experiment, subject, run, exposure, seconds, events, fallback, sequence, lineage, **more) -> Column:
        given = {
            "experiment": F.lit("exp"), "version": F.lit("1"), "variant": experiment, "subject": subject, "session": text("synthetic-session:", "o_orderkey"), "run": run, "exposure": exposure, "window_seconds": seconds, "events": events,
            "fallback": fallback, "checkpoint": F.lit("orders"), "sequence": sequence, "recorded_at": recorded, "lineage": lineage, **more,
        }
        return F.struct(*(c.alias(k) for k, c in given.items()))

    variant = F.concat(F.lit("v"), (F.col("o_custkey") % 2).cast("string"))
    run, subject, exposure = text("synthetic-run:", "o_orderkey"), text("synthetic-subject:", "o_custkey"), text("x", "o_orderkey")
    fallback = key % 5 == 0
    reference = side(variant, subject, run, exposure, F.lit(WINDOW_SECONDS), F.col("events"), fallback, key, exposure)
    candidate = side(
        F.when(key % 53 == 0, "v9").otherwise(variant), F.when(key % 59 == 0, "synthetic-subject:0").otherwise(subject), run, exposure, F.when(key % 61 == 0, 86_400).otherwise(WINDOW_SECONDS), F.col("told"),
        fallback | (key % 67 == 0), F.when(key % 71 == 0, key - 1).otherwise(key), F.when(key % 73 == 0, "x").otherwise(exposure), max_staleness=F.lit(48 * 3600), authority=F.when(key % 79 == 0, "p0").otherwise(AUTHORITY), kind=F.lit(EXPOSURE_KIND),
        fallback_run=F.when(fallback & (key % 83 != 0), run), stale_gap=key % 7 == 0, dedupe_gap=key % 11 == 0,
    )
    return rows.select(key.alias("case_id"), reference.alias("reference"), candidate.alias("candidate"), _bound("o_custkey").alias("identity"), now().alias("at"))


# The same in SQL.
def _esc(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '([\\,=\[\]{{}}])', '\\\1', 'g'), '\r\n|\r', chr(10), 'g')"


def _sql_row(dimension: str, same: str, match: str, mismatch: str, expected: str, actual: str, blocks: bool = True) -> str:
    same = f"coalesce({same}, FALSE)"
    return f"SELECT case_id, '{dimension}' AS dimension, CASE WHEN {same} THEN '{match}' ELSE {mismatch} END AS classification, coalesce({expected}, '<empty>') AS expected, coalesce({actual}, '<empty>') AS actual, {'NOT ' + same if blocks else 'FALSE'} AS blocking FROM c"


def _sql_safe(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN '<empty>' WHEN regexp_matches({x}, '^({'|'.join(SENSITIVE)})') THEN 'sha256:' || sha256({x}) ELSE {_esc(x)} END"


def _sql_identity() -> str:
    parts = [(c.replace("identity.", "i_").replace(" <=> ", " IS NOT DISTINCT FROM ").replace("> at", f"> TIMESTAMP '{NOW}'"), k, s.replace("identity.", "i_")) for c, k, s in IDENTITY]
    kind = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k, _ in parts) + " END"
    status = "CASE " + " ".join(f"WHEN {c} THEN {s}" for c, _, s in parts) + " ELSE 'VALID' END"
    return _sql_row("IDENTITY_BLOCKED", f"({kind}) IS NULL", "MATCH_EXACT", kind, "'synthetic-binding-valid'", status)


def _sql_checkpoint(name: str, staleness: int) -> str:
    text = lambda s: f"'{name}|' || coalesce({s}_sequence::VARCHAR, '') || '|' || coalesce(epoch({s}_at)::BIGINT::VARCHAR, '')"
    same, age = "r_sequence IS NOT DISTINCT FROM c_sequence", f"(floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(c_at)))"
    return _sql_row("SOURCE_CHECKPOINT_PARITY", f"{same} AND {age} >= 0 AND {age} < {staleness}", "MATCH_EXACT", f"CASE WHEN {same} THEN 'SOURCE_STALE' ELSE 'SOURCE_CHECKPOINT_MISMATCH' END", text("r"), text("c"))


def _identity_columns(key: str) -> str:
    return ", ".join(f"{v.format(key)} AS i_{k}" for k, v in _BOUND.items())


def _map_sql(key: str, n: str, at: str) -> str:
    return f"'{{' || coalesce(string_agg({_esc(key)} || '=' || {n}, ',' ORDER BY {key}) FILTER (WHERE {n} > 0 AND {at}), '') || '}}'"


_LACKS = [("ORDERING_NOT_COMPARABLE", "FALSE"), ("EVENT_GRAIN_MISSING", "FALSE"), ("EXPLICIT_PREFERENCE_MISSING", "case_id % 2 = 0"), ("TRANSFORM_POLICY_MISSING", "FALSE")]
_PROFILE = f"""WITH f AS (SELECT user_id, w, kind, count(*) FILTER (WHERE age < w * 86400) AS n, count(*) FILTER (WHERE age < w * 86400 AND seen) AS m FROM (SELECT *, event_id % 401 <> 0 AS seen, floor(epoch(TIMESTAMP '{NOW}')) - floor(epoch(ts)) AS age FROM behaviour),
        (VALUES (7), (30), (90), (20000)) v(w) GROUP BY 1, 2, 3),
    g AS (SELECT user_id, w, kind, CASE WHEN w < 1000 THEN w || 'd:' || kind ELSE kind END AS k, n, m FROM f),
    t AS (SELECT user_id, {_map_sql('k', 'n', 'w > 1000')} AS r_counts, {_map_sql('k', 'm', 'w > 1000')} AS c_counts, {_map_sql('k', 'n', 'w < 1000')} AS r_windows, {_map_sql('k', 'm', 'w < 1000')} AS c_windows FROM g GROUP BY 1),
    l AS (SELECT user_id, max(event_id) AS r_sequence, max(event_id) FILTER (WHERE event_id % 401 <> 0) AS c_sequence, max(date_trunc('second', ts)) AS r_at, max(date_trunc('second', ts)) FILTER (WHERE event_id % 401 <> 0) AS c_at FROM behaviour GROUP BY 1),
    c AS (SELECT t.user_id AS case_id, t.*, l.* EXCLUDE (user_id), {_identity_columns('t.user_id')} FROM t JOIN l USING (user_id)),
    d AS ({' UNION ALL '.join([
        _sql_identity(),
        _sql_row("EXACT_FIELD_PARITY", "case_id % 17 <> 0", "MATCH_EXACT", "'RECONCILIATION_INCONCLUSIVE'", "'{schema=v1,user=' || case_id || '}'", r"'{schema=' || CASE WHEN case_id % 17 = 0 THEN 'v\{0\}' ELSE 'v1' END || ',user=' || case_id || '}'"),
        _sql_row("DERIVED_VALUE_PARITY", "r_counts = c_counts", "MATCH_DERIVED", "'RECONCILIATION_INCONCLUSIVE'", "r_counts", "c_counts"),
        _sql_row("AGGREGATE_WINDOW_PARITY", "r_windows = c_windows", "MATCH_EXACT", "'RECONCILIATION_INCONCLUSIVE'", "r_windows", "c_windows"),
        _sql_checkpoint("behaviour", 10 * 86400),
        _sql_row("SOURCE_LINEAGE_PARITY", "case_id % 19 <> 0", "MATCH_EXACT", "'LINEAGE_MISMATCH'", "'l' || case_id", "CASE WHEN case_id % 19 = 0 THEN 'x' ELSE 'l' END || case_id"),
        *(_sql_row(name, has, "MATCH_EXACT", "'EXPECTED_SEMANTIC_GAP'", f"CASE WHEN {has} THEN 'available' ELSE 'authoritative-only' END", f"CASE WHEN {has} THEN 'available' ELSE 'candidate-missing' END", False) for name, has in _LACKS),
        _sql_row("FINGERPRINT_SEMANTICS_PROTECTED", "FALSE", "", "'PROTECTED_AUTHORITY_DIFFERENCE'", "'protected-profile-fingerprint'", "'candidate-projection-fingerprint'", False),
    ])})"""
_KIND = "CASE WHEN l_returnflag = 'A' THEN 'click' WHEN l_returnflag = 'R' THEN 'save' WHEN l_partkey % 2 = 0 THEN 'like' ELSE 'share' END"
_TOLD = f"CASE WHEN l_linenumber = 3 AND l_partkey % 97 = 0 THEN 'view' WHEN l_partkey % 101 <> 0 THEN {_KIND} END"
_V = "'exp|1|v' || (cust % 2)"
_CV = "'exp|1|' || CASE WHEN case_id % 53 = 0 THEN 'v9' ELSE 'v' || (cust % 2) END"
_B = "'sha256:' || sha256({0} || '|synthetic-session:' || case_id || '|synthetic-run:' || case_id || '|x' || case_id)"
_RB, _CB = _B.format("'synthetic-subject:' || cust"), _B.format("CASE WHEN case_id % 59 = 0 THEN 'synthetic-subject:0' ELSE 'synthetic-subject:' || cust END")
_GAP = [("STALE_UNEXPOSED_ASSIGNMENT_GAP", "case_id % 7 = 0"), ("OBSERVATION_DEDUPE_GAP", "case_id % 11 = 0")]
_EXPERIMENT = f"""WITH k AS (SELECT l_orderkey, {_KIND} AS kind, {_TOLD} AS told FROM lineitem),
    s AS (SELECT l_orderkey, string_agg(DISTINCT kind, ',' ORDER BY kind) AS events, string_agg(DISTINCT told, ',' ORDER BY told) AS told, bool_or(told = 'view') AS odd FROM k GROUP BY 1),
    c AS (SELECT o_orderkey AS case_id, o_custkey AS cust, '[' || coalesce(events, '') || ']' AS events, '[' || coalesce(told, '') || ']' AS told, coalesce(odd, FALSE) AS odd, o_orderkey AS r_sequence, CASE WHEN o_orderkey % 71 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS c_sequence,
        TIMESTAMP '{NOW}' - to_hours(o_orderkey % 50) AS r_at, TIMESTAMP '{NOW}' - to_hours(o_orderkey % 50) AS c_at, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 83 <> 0 THEN 'synthetic-run:' || o_orderkey END AS fallback_run, {_identity_columns('o_custkey')} FROM orders LEFT JOIN s ON l_orderkey = o_orderkey),
    d AS ({' UNION ALL '.join([
        _sql_identity(),
        _sql_row("ASSIGNMENT_PARITY", f"{_V} = {_CV}", "MATCH_EXACT", "'RECONCILIATION_INCONCLUSIVE'", _V, _CV),
        _sql_row("SUBJECT_SESSION_RUN_PARITY", f"{_RB} = {_CB}", "MATCH_EXACT", "'IDENTITY_SCHEME_MISMATCH'", _RB, _CB),
        _sql_row("EXPOSURE_REFERENCE_PARITY", "case_id % 79 <> 0", "MATCH_EXACT", "'EXPOSURE_AUTHORITY_MISMATCH'", f"'{AUTHORITY}|x' || case_id", f"CASE WHEN case_id % 79 = 0 THEN 'p0' ELSE '{AUTHORITY}' END || '|x' || case_id"),
        _sql_row("OUTCOME_WINDOW_PARITY", "case_id % 61 <> 0", "MATCH_EXACT", "'OUTCOME_WINDOW_MISMATCH'", f"'{WINDOW_SECONDS}'", f"CASE WHEN case_id % 61 = 0 THEN '86400' ELSE '{WINDOW_SECONDS}' END"),
        _sql_row("ENGAGEMENT_EVENT_PARITY", "NOT odd AND events = told", "MATCH_EXACT", "'PROTECTED_AUTHORITY_DIFFERENCE'", "events", "told"),
        _sql_row("FALLBACK_BINDING_PARITY", "NOT (case_id % 5 = 0 OR case_id % 67 = 0) OR (case_id % 5 = 0 AND fallback_run IS NOT NULL)", "MATCH_EXACT", "'FALLBACK_BINDING_MISMATCH'", _sql_safe("('synthetic-run:' || case_id)"), _sql_safe("fallback_run")),
        *(_sql_row(name, f"NOT ({gap})", "MATCH_EXACT", "'MIGRATION_REQUIRED'", "'no-gap'", f"CASE WHEN {gap} THEN 'migration-gap' ELSE 'no-gap' END", False) for name, gap in _GAP),
        _sql_row("CANONICAL_DATASET_HASH_PROTECTED", "FALSE", "", "'PROTECTED_AUTHORITY_DIFFERENCE'", "'protected-canonical-hash'", "'not-read-or-recalculated'", False),
        _sql_row("RELEASE_EVIDENCE_PROTECTED", "FALSE", "", "'PROTECTED_AUTHORITY_DIFFERENCE'", "'protected-release-evidence'", "'not-read-or-modified'", False),
        _sql_checkpoint("orders", 48 * 3600),
        _sql_row("SOURCE_LINEAGE_PARITY", "case_id % 73 <> 0", "MATCH_EXACT", "'LINEAGE_MISMATCH'", "'x' || case_id", "CASE WHEN case_id % 73 = 0 THEN 'x' ELSE 'x' || case_id END"),
    ])})"""
_VERDICTS = """ SELECT case_id, CASE WHEN bool_or((dimension = 'IDENTITY_BLOCKED' AND blocking) OR (dimension = 'SUBJECT_SESSION_RUN_PARITY' AND classification = 'IDENTITY_SCHEME_MISMATCH')) THEN 'BLOCKED_BY_IDENTITY' WHEN bool_or(blocking) THEN 'BLOCKED_BY_UNEXPECTED_MISMATCH'
    WHEN bool_or(classification = 'MIGRATION_REQUIRED') THEN 'RECONCILED_WITH_MIGRATION_GAPS' ELSE 'RECONCILED_WITH_EXPECTED_GAPS' END AS verdict, count(*) FILTER (WHERE blocking) AS blocking FROM d GROUP BY 1"""


def _verdicts(cases: DataFrame, dimensions: Column) -> DataFrame:
    return reconcile(cases, dimensions).select("case_id", "verdict", F.size(F.filter("dimensions", lambda x: x["blocking"])).cast("long").alias("blocking"))


@query("profile_reconciliation", f"{_PROFILE} SELECT * FROM d", ("behaviour",))
def profile_reconciliation(d: Domain) -> DataFrame:
    """Recorded and projected profiles in eleven dimensions."""
    return reconcile(profile_cases(d), profile_dimensions()).select("case_id", F.inline("dimensions"))


@query("profile_reconciliation_verdicts", _PROFILE + _VERDICTS, ("behaviour",))
def profile_reconciliation_verdicts(d: Domain) -> DataFrame:
    return _verdicts(profile_cases(d), profile_dimensions())


@query("experiment_reconciliation", f"{_EXPERIMENT} SELECT * FROM d")
def experiment_reconciliation(d: Domain) -> DataFrame:
    """Recorded and projected observations of an experiment in thirteen dimensions."""
    return reconcile(experiment_cases(d), experiment_dimensions()).select("case_id", F.inline("dimensions"))


@query("experiment_reconciliation_verdicts", _EXPERIMENT + _VERDICTS)
def experiment_reconciliation_verdicts(d: Domain) -> DataFrame:
    return _verdicts(experiment_cases(d), experiment_dimensions())
