"""Quality of snapshots: seven scopes of checks, fifteen metrics, anomalies and a verdict, for any number of snapshots at once.

The inputs are tables keyed by snapshot: what a checkpoint captured, the sources, records and lineage there are now, records rebuilt
from the checkpoint, bindings of identities and exposures, and what the snapshot says of itself. Each key space (sources,
records, identities, exposures) is one union of its tables and one grouping by (snapshot, key), so nothing is joined; the sums of
each are MEASURES, one row per snapshot. CHECKS and METRICS are tables over the measures, evaluated in one projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fingerprint import fold, row_hash, row_text, sql_fold, sql_text
from ..sources.tables import Domain
from .registry import query

FROM, TO, BOUND, TOLERANCE = "2024-01-03 00:00:00", "2024-01-28 00:00:00", "2024-01-28 00:00:00", "2024-01-28 12:00:00"
SCOPES = ("SOURCE_COMPLETENESS", "PROJECTION_COMPLETENESS", "SNAPSHOT_CONSISTENCY", "LINEAGE_INTEGRITY", "IDENTITY_INTEGRITY", "EXPOSURE_INTEGRITY", "DETERMINISTIC_REBUILD")

# First failures of a binding, in the order they are looked for.
IDENTITY_FAILURES = ("IDENTITY_BINDING_MISSING", "IDENTITY_NAMESPACE_CONFLICT", "IDENTITY_BINDING_FINGERPRINT_MISMATCH", "IDENTITY_BINDING_INVALID", "IDENTITY_BINDING_SCOPE_MISMATCH", "IDENTITY_PROJECTION_SUBJECT_MISMATCH")
EXPOSURE_FAILURES = (
    "EXPOSURE_BINDING_MISSING", "DUPLICATE_EXPOSURE_AMBIGUITY", "GENERAL_EXPOSURE_USED_AS_P2", "EXPOSURE_SUBJECT_MISMATCH", "EXPOSURE_VARIANT_MISMATCH", "EXPOSURE_EXPERIMENT_MISMATCH", "EXPOSURE_TIME_MISMATCH", "FALLBACK_AUTHORITY_MISMATCH",
)


def _case(*pairs: str) -> str:
    return f"CASE {' '.join(f'WHEN {c} THEN {v}' for c, v in zip(pairs[::2], pairs[1::2], strict=True))} END"


def _fails(*pairs: str) -> str:
    """Condition, failure, condition, failure ...: the first that holds."""
    return _case(*(f"'{x}'" if i % 2 else x for i, x in enumerate(pairs)))


_REBUILT = "e_count > 0"
#: (scope, code, severity, when it is evaluated, what it is else, failure or null) over the measures.
CHECKS = (
    (0, "source.count", "BLOCKER", "true", "", _fails("m_count <> a_count", "SOURCE_COUNT_MISMATCH")),
    (0, "source.set_fingerprint", "BLOCKER", "true", "", _fails("m_print <> a_print", "SOURCE_SET_FINGERPRINT_MISMATCH")),
    (0, "source.membership", "BLOCKER", "true", "", _fails("missing > 0", "SOURCE_EVENT_MISSING", "unexpected > 0 or conflicting > 0", "SOURCE_EVENT_UNEXPECTED")),
    (0, "source.range", "BLOCKER", "true", "", _fails("out_of_range > 0", "SOURCE_EVENT_OUT_OF_RANGE")),
    (0, "source.timestamp", "BLOCKER", "true", "", _fails("wrong_time > 0", "SOURCE_TIMESTAMP_MISMATCH")),
    (1, "projection.records", "BLOCKER", "true", "", _fails(f"not ({_REBUILT})", "PROJECTION_RECORD_MISSING", "r_missing > 0", "PROJECTION_RECORD_MISSING", "r_unexpected > 0 or r_rows > r_count", "PROJECTION_RECORD_UNEXPECTED")),
    (1, "projection.source_count", "BLOCKER", _REBUILT, "SKIPPED", _fails("r_missing > 0 or r_count_diff > 0", "PROJECTION_SOURCE_COUNT_MISMATCH")),
    (1, "projection.aggregation", "BLOCKER", _REBUILT, "SKIPPED", _fails("r_missing > 0 or r_print_diff > 0", "PROJECTION_AGGREGATION_MISMATCH")),
    (1, "projection.adapter_evidence", "BLOCKER", "true", "", _fails("conflicted > 0", "CONFLICTED_ADAPTER_EVIDENCE_INCLUDED", "rejected > 0", "REJECTED_ADAPTER_EVIDENCE_INCLUDED")),
    (2, "snapshot.record_count", "BLOCKER", "true", "", _fails("s_records <> r_rows", "SNAPSHOT_RECORD_COUNT_MISMATCH")),
    (2, "snapshot.subject_count", "BLOCKER", "true", "", _fails("s_subjects <> subjects", "SNAPSHOT_SUBJECT_COUNT_MISMATCH")),
    (2, "snapshot.source_count", "BLOCKER", "true", "", _fails("s_sources <> l_sources", "SNAPSHOT_SOURCE_COUNT_MISMATCH")),
    (2, "snapshot.content_fingerprint", "BLOCKER", "true", "", _fails("s_content <> r_print", "SNAPSHOT_CONTENT_FINGERPRINT_MISMATCH")),
    (2, "snapshot.lineage_fingerprint", "BLOCKER", "true", "", _fails("s_lineage <> l_print", "SNAPSHOT_LINEAGE_FINGERPRINT_MISMATCH")),
    (2, "snapshot.as_of", "BLOCKER", "true", "", _fails("not s_as_of", "SNAPSHOT_AS_OF_MISMATCH")),
    (2, "snapshot.status", "BLOCKER", "true", "", _fails("s_status not in ('CREATED', 'VALIDATED')", "SNAPSHOT_STATUS_INVALID")),
    (3, "lineage.completeness", "BLOCKER", "true", "", _fails("r_count = 0 or r_bare > 0", "LINEAGE_MISSING")),
    (3, "lineage.orphan", "BLOCKER", "true", "", _fails("l_orphans > 0", "LINEAGE_ORPHAN")),
    (3, "lineage.duplicate", "BLOCKER", "true", "", _fails("l_repeats > 0", "LINEAGE_DUPLICATE")),
    (3, "lineage.source", "BLOCKER", "true", "", _fails("l_changed > 0", "LINEAGE_SOURCE_FINGERPRINT_MISMATCH", "l_lost > 0", "LINEAGE_SOURCE_MISSING")),
    (3, "lineage.adapter_evidence", "BLOCKER", "true", "", _fails("l_evidence > 0", "LINEAGE_ADAPTER_EVIDENCE_MISMATCH")),
    (3, "lineage.binding", "BLOCKER", "true", "", _fails("l_policy > 0", "LINEAGE_CHECKPOINT_MISMATCH")),
    (3, "lineage.fingerprint", "BLOCKER", "true", "", _fails("s_lineage <> l_print", "LINEAGE_FINGERPRINT_MISMATCH")),
    (4, "identity.binding", "BLOCKER", "true", "", _case(*(x for i, f in enumerate(IDENTITY_FAILURES) for x in (f"i_failure = {i}", f"'{f}'")))),
    (5, "exposure.binding", "BLOCKER", "outcome", "NOT_APPLICABLE", _case(*(x for i, f in enumerate(EXPOSURE_FAILURES) for x in (f"x_failure = {i}", f"'{f}'")))),
    (6, "rebuild.match", "BLOCKER", "true", "", _fails("e_print <> r_print", "REBUILD_MISMATCH")),
)

_FINGERPRINTS = ("m_print = a_print", "s_content = r_print", "s_lineage = l_print", "s_lineage = l_print")
#: (metric, numerator, denominator, whether it must be one rather than zero) over the measures.
METRICS = (
    ("source_completeness_rate", "least(a_count, m_count)", "m_count", True),
    ("projection_coverage_rate", "least(r_rows, e_count)", "e_count", True),
    ("lineage_completeness_rate", "r_count - r_bare", "r_count", True),
    ("lineage_orphan_rate", "l_orphans", "l_rows", False),
    ("duplicate_source_rate", "conflicting", "n_sources", False),
    ("duplicate_lineage_rate", "l_repeats", "l_rows", False),
    ("snapshot_record_reconciliation_rate", "CASE WHEN s_records = r_rows THEN 1 ELSE 0 END", "1", True),
    ("snapshot_subject_reconciliation_rate", "CASE WHEN s_subjects = subjects THEN 1 ELSE 0 END", "1", True),
    ("snapshot_source_reconciliation_rate", "CASE WHEN s_sources = l_sources THEN 1 ELSE 0 END", "1", True),
    ("fingerprint_match_rate", " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in _FINGERPRINTS), str(len(_FINGERPRINTS)), True),
    ("identity_binding_valid_rate", "i_valid", "i_required", True),
    ("exposure_binding_valid_rate", "CASE WHEN outcome THEN x_valid ELSE 0 END", "CASE WHEN outcome THEN x_required ELSE 0 END", True),
    ("late_arrival_rate", "late", "n_sources", False),
    ("conflict_rate", "conflicting", "n_sources", False),
    ("rebuild_match_rate", "CASE WHEN e_print = r_print THEN 1 ELSE 0 END", "1", True),
)

#: Measures that are texts; all others are numbers.
_TEXTS = ("a_print", "m_print", "r_print", "e_print", "l_print", "s_content", "s_lineage", "s_status")
_EMPTY = "0:0:0"


class Inputs:
    """Tables by snapshot. Stand-ins from behaviour: a member's saves and clicks are the sources of the member's snapshot, its records are themes,
    and defects are planted in the rows themselves, each in some members or events."""

    def __init__(self, d: Domain):
        at = lambda t: F.lit(t).cast("timestamp")
        e, u = F.col("event_id"), F.col("user_id")
        b = d.behaviour.filter("kind in ('click', 'save')").select(
            u.alias("snapshot"), e.alias("source"), (F.col("post_id") % 6).alias("record"), F.col("ts").alias("occurred"), (F.col("ts") + F.make_dt_interval(hours=(e % 50).cast("int"))).alias("ingested"),
            F.concat(F.lit("p"), (e % 7).cast("string")).alias("print"), F.when(e % 4 != 0, F.concat(F.lit("a"), (e % 5).cast("string"))).alias("evidence"),
            F.when(e % 1009 == 0, "REJECTED").when(e % 811 == 0, "CONFLICTED").otherwise("MAPPED").alias("state"),
            F.concat(F.when(e % 10 == 0, "subject:").otherwise("user:"), u.cast("string")).alias("identity"),
        )
        s, x = F.col("snapshot"), F.col("source")
        inside = (F.col("occurred") >= at(FROM)) & (F.col("occurred") < at(TO))
        captured = b.filter(inside & (F.col("ingested") <= at(BOUND)))
        self.members = captured.withColumn("occurred", F.when(x % 709 == 0, F.col("occurred") + F.expr("interval 1 second")).otherwise(F.col("occurred")))
        now = b.filter((inside | (s % 7 == 2)) & (x % 601 != 3)).withColumn("print", F.when(x % 401 == 0, "x").otherwise(F.col("print")))
        copies = F.when(x % 331 == 0, F.array(F.lit(0), F.lit(0))).when(x % 431 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        self.sources = now.withColumn("k", F.explode(copies)).withColumn("print", F.when(F.col("k") == 1, "y").otherwise(F.col("print"))).drop("k")
        rebuilt = captured.groupBy("snapshot", "record").agg(F.count("*").alias("n"), F.min("source").alias("lo"), F.max("source").alias("hi"))
        self.expected = rebuilt.select("snapshot", "record", "n", F.concat_ws(":", "n", "lo", "hi").alias("print"))
        there = self.expected.filter(~((s % 17 == 3) & (F.col("record") == 0))).select(
            "snapshot", "record", F.concat(F.lit("subject:"), s.cast("string")).alias("subject"), (F.col("n") + F.when((s % 19 == 4) & (F.col("record") == 1), 1).otherwise(0)).alias("n"),
            F.when((s % 47 == 5) & (F.col("record") == 2), "?").otherwise(F.col("print")).alias("print"),
        )
        more = there.filter(s % 53 == 6).select("snapshot", F.lit(7).cast("long").alias("record"), "subject", F.lit(0).cast("long").alias("n"), F.lit("0").alias("print")).distinct()
        self.records = there.unionByName(more)
        lineage = captured.filter(~((s % 59 == 8) & (F.col("record") == 3))).select(
            "snapshot", F.when((s % 23 == 5) & (F.col("record") == 0), 9).otherwise(F.col("record")).alias("record"), "source", "print",
            F.when(x % 503 == 0, "z").otherwise(F.col("evidence")).alias("evidence"), F.when(s % 43 == 9, "v0").otherwise("v1").alias("policy"),
        )
        self.lineage = lineage.withColumn("k", F.explode(F.when(x % 307 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))))).drop("k")
        people = d.members.select(F.col("user_id").alias("snapshot")).filter(s % 29 != 7)
        text = lambda head, test, other: F.when(test, other).otherwise(F.concat(F.lit(head), s.cast("string")))
        bound = people.select(
            "snapshot", F.concat(F.lit("user:"), s.cast("string")).alias("identity"), F.concat(F.lit("subject:"), s.cast("string")).alias("target"), F.lit("b1").alias("print"),
            F.when(s % 13 == 6, "b0").otherwise("b1").alias("authoritative"), F.when(s % 61 == 10, "old").otherwise("now").alias("checkpoint"),
            F.when(s % 67 == 11, "elsewhere").otherwise("journey-connect").alias("scope"), text("subject:", s % 71 == 12, "subject:none").alias("projected"),
        )
        self.bindings = bound.unionByName(bound.filter(s % 31 == 8).withColumn("target", F.lit("subject:other")))
        shown = self.expected.filter((s % 2 == 0) & ~((s % 16 == 4) & (F.col("record") == 1))).select(
            "snapshot", "record", (s % 14 != 6).alias("authoritative"), text("subject:", s % 22 == 10, "subject:none").alias("subject"), (s % 34 != 12).alias("variant"), (s % 38 != 14).alias("experiment"),
            (s % 46 != 16).alias("time"), (s % 58 != 18).alias("fallback"),
        )
        self.exposures = shown.unionByName(shown.filter((s % 26 == 8) & (F.col("record") == 2)))
        stored = self.expected.groupBy("snapshot").agg(F.count("*").alias("s_records"), fold(row_hash(row_text("record", "n", "print"))).alias("s_content"))
        traced = captured.withColumn("policy", F.lit("v1")).groupBy("snapshot").agg(F.countDistinct("source").alias("s_sources"), fold(row_hash(row_text("record", "source", "print", "evidence", "policy"))).alias("s_lineage"))
        self.stored = stored.unionByName(traced, allowMissingColumns=True).groupBy("snapshot").agg(*(F.max(c).alias(c) for c in ("s_records", "s_content", "s_sources", "s_lineage"))).select(
            "snapshot", (F.col("s_records") + F.when(s % 83 == 15, 1).otherwise(0)).alias("s_records"), F.lit(1).cast("long").alias("s_subjects"), "s_sources", "s_content", "s_lineage",
            (s % 79 != 14).alias("s_as_of"), F.when(s % 73 == 13, "REJECTED").otherwise("CREATED").alias("s_status"), (s % 2 == 0).alias("outcome"),
        )


def _tagged(**tables: DataFrame) -> DataFrame:
    """Rows of several tables under each other, with `_of` naming the table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.withColumn("_of", F.lit(n)) for n, t in tables.items()))


def _of(name: str, value: Column | None = None) -> Column:
    return F.when(F.col("_of") == name, F.lit(1) if value is None else value)


def by_source(t: Inputs) -> DataFrame:
    """Per (snapshot, source): what the checkpoint, the sources and the lineage say of it."""
    at = lambda x: F.lit(x).cast("timestamp")
    payload = row_text("print", "evidence", "occurred", "ingested", "state")
    sources = t.sources.withColumns({"in_range": (F.col("occurred") >= at(FROM)) & (F.col("occurred") < at(TO)), "payload": payload, "known": F.concat_ws("|", "print", F.coalesce("evidence", F.lit("~")))})
    sources = sources.withColumn("accepted", F.col("in_range") & (F.col("ingested") <= at(BOUND)))
    rows = _tagged(s=sources, m=t.members.withColumn("in_range", F.lit(True)), l=t.lineage)
    taken = F.col("accepted")
    times = F.struct("occurred", "ingested")
    grouped = rows.groupBy("snapshot", "source").agg(
        F.count(_of("s")).alias("s_rows"), F.count(_of("s", F.when(taken, 1))).alias("s_in"), F.min(_of("s", F.when(taken, F.col("payload")))).alias("s_lo"), F.max(_of("s", F.when(taken, F.col("payload")))).alias("s_hi"),
        F.min(_of("s", F.when(taken, F.col("print")))).alias("s_print"), F.min(_of("s", F.when(taken, times))).alias("s_times"), F.min(_of("s", F.when(taken, F.col("state")))).alias("s_state"),
        F.count_if((F.col("_of") == "s") & ~F.col("in_range")).alias("s_out"), F.count_if((F.col("_of") == "s") & F.col("in_range") & (F.col("ingested") > at(BOUND))).alias("s_late"),
        F.collect_set(_of("s", F.col("known"))).alias("s_known"), F.min(_of("s", F.col("identity"))).alias("identity"),
        F.count(_of("m")).alias("m_in"), F.min(_of("m", F.col("print"))).alias("m_print"), F.min(_of("m", times)).alias("m_times"),
        F.count(_of("l")).alias("l_rows"), F.min(_of("l", F.col("print"))).alias("l_print"), F.min(_of("l", F.coalesce("evidence", F.lit("~")))).alias("l_evidence"),
    )
    # sources under one key are few, so their known prints are
    prints = F.transform("s_known", lambda k: F.split_part(k, F.lit("|"), F.lit(1)))
    traced = F.col("l_rows") > 0
    return grouped.withColumns({"l_found": traced & F.array_contains(prints, F.col("l_print")), "l_changed": traced & (F.col("s_rows") > 0) & ~F.array_contains(prints, F.col("l_print")), "l_lost": traced & ~F.array_contains(prints, F.col("l_print")),
        "l_other": traced & F.array_contains(prints, F.col("l_print")) & ~F.array_contains("s_known", F.concat_ws("|", "l_print", "l_evidence"))})


def measures(t: Inputs) -> DataFrame:
    """One row of measures per snapshot."""
    n = lambda c: F.count_if(F.expr(c) if isinstance(c, str) else c)
    sources = by_source(t)
    source_sums = sources.groupBy("snapshot").agg(
        n("m_in > 0").alias("m_count"), n("s_in > 0").alias("a_count"), n("m_in > 0 and s_in = 0").alias("missing"), n("m_in = 0 and s_in > 0").alias("unexpected"), n("s_lo <> s_hi").alias("conflicting"), F.sum("s_out").alias("out_of_range"),
        n("m_in > 0 and s_in > 0 and m_times <> s_times").alias("wrong_time"), F.sum("s_late").alias("late"), F.sum("s_rows").alias("n_sources"), n("m_in > 0 and s_state = 'REJECTED'").alias("rejected"), n("m_in > 0 and s_state = 'CONFLICTED'").alias("conflicted"),
        fold(F.when(F.col("m_in") > 0, row_hash(row_text("source", "m_print")))).alias("m_print"), fold(F.when(F.col("s_in") > 0, row_hash(row_text("source", "s_print")))).alias("a_print"),
        F.sum("l_rows").alias("l_rows"), n("l_rows > 0").alias("l_sources"), n("l_changed").alias("l_changed"), n("l_lost").alias("l_lost"), n("l_other").alias("l_evidence"),
    )
    lineage = t.lineage.groupBy("snapshot", "record", "source", "print", "evidence", "policy").agg(F.count("*").alias("rows"))
    text = row_hash(row_text("record", "source", "print", "evidence", "policy"))
    lineage_sums = lineage.groupBy("snapshot").agg(F.sum(F.col("rows") - 1).alias("l_repeats"), n("policy <> 'v1'").alias("l_policy"), fold(text).alias("l_print"))
    rows = _tagged(r=t.records, e=t.expected, l=lineage.groupBy("snapshot", "record").agg(F.sum("rows").alias("n")))
    records = rows.groupBy("snapshot", "record").agg(
        F.count(_of("r")).alias("r_rows"), F.max(_of("r", F.col("n"))).alias("r_n"), F.max(_of("r", F.col("print"))).alias("r_print"), F.max(_of("r", F.col("subject"))).alias("subject"),
        F.count(_of("e")).alias("e_rows"), F.max(_of("e", F.col("n"))).alias("e_n"), F.max(_of("e", F.col("print"))).alias("e_print"), F.coalesce(F.sum(_of("l", F.col("n"))), F.lit(0)).alias("l_rows"),
    )
    record_sums = records.groupBy("snapshot").agg(
        n("r_rows > 0").alias("r_count"), F.sum("r_rows").alias("r_rows"), n("e_rows > 0").alias("e_count"), n("e_rows > 0 and r_rows = 0").alias("r_missing"), n("e_rows = 0 and r_rows > 0").alias("r_unexpected"), n("r_n <> e_n").alias("r_count_diff"),
        n("r_n <> e_n or r_print <> e_print").alias("r_print_diff"), n("r_rows > 0 and l_rows = 0").alias("r_bare"), F.sum(F.when(F.col("r_rows") == 0, F.col("l_rows")).otherwise(0)).alias("l_orphans"),
        F.countDistinct("subject").alias("subjects"),
        fold(F.when(F.col("r_rows") > 0, row_hash(row_text("record", "r_n", "r_print")))).alias("r_print"), fold(F.when(F.col("e_rows") > 0, row_hash(row_text("record", "e_n", "e_print")))).alias("e_print"),
    )
    needed = sources.filter("l_found and identity not like 'subject:%'").groupBy("snapshot", "identity").agg(F.lit(1).alias("one"))
    subject = F.concat(F.lit("subject:"), F.col("snapshot").cast("string"))
    contract = F.struct("target", "print", "authoritative", "checkpoint", "scope", "projected")
    people = _tagged(n=needed, b=t.bindings).groupBy("snapshot", "identity").agg(
        F.count(_of("n")).alias("needed"), F.count(_of("b")).alias("bound"), F.min(_of("b", contract)).alias("b_lo"), F.max(_of("b", contract)).alias("b_hi"),
    ).filter("needed > 0")
    b = F.col("b_lo")
    failure = (
        F.when(F.col("bound") == 0, 0).when(F.col("b_lo") != F.col("b_hi"), 1).when(b["print"] != b["authoritative"], 2).when(b["checkpoint"] != "now", 3).when(b["scope"] != "journey-connect", 4)
        .when((b["target"] != subject) | (b["projected"] != subject), 5)
    )
    identity_sums = people.withColumn("f", failure).groupBy("snapshot").agg(F.count("*").alias("i_required"), n((F.col("bound") == 1) & F.col("f").isNull()).alias("i_valid"), F.min("f").alias("i_failure"))
    shown = _tagged(r=t.records.select("snapshot", "record", "subject"), x=t.exposures).groupBy("snapshot", "record").agg(
        F.count(_of("r")).alias("needed"), F.count(_of("x")).alias("found"), F.max(_of("r", F.col("subject"))).alias("whose"), F.max(_of("x", F.col("subject"))).alias("bound_to"),
        *(F.min(_of("x", F.col(c))).alias(c) for c in ("authoritative", "variant", "experiment", "time", "fallback")),
    ).filter("needed > 0")
    failure = (
        F.when(F.col("found") == 0, 0).when(F.col("found") > 1, 1).when(~F.col("authoritative"), 2).when(F.col("bound_to") != F.col("whose"), 3).when(~F.col("variant"), 4).when(~F.col("experiment"), 5)
        .when(~F.col("time"), 6).when(~F.col("fallback"), 7)
    )
    exposure_sums = shown.withColumn("f", failure).groupBy("snapshot").agg(F.count("*").alias("x_required"), n(F.col("f").isNull()).alias("x_valid"), F.min("f").alias("x_failure"))
    parts = [source_sums, lineage_sums, record_sums, identity_sums, exposure_sums, t.stored]
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    fill = lambda c: F.max(c).alias(c) if c in ("i_failure", "x_failure", "s_as_of", "s_status", "outcome") else F.coalesce(F.max(c), F.lit(_EMPTY) if c in _TEXTS else F.lit(0)).alias(c)
    return wide.groupBy("snapshot").agg(*(fill(c) for c in wide.columns if c != "snapshot")).filter("s_status is not null")


def checked(wide: DataFrame) -> DataFrame:
    """snapshot, checks (array of scope, code, severity, status, failure) and metrics (array of metric, numerator, denominator, value, status)."""
    checks = []
    for scope, code, severity, when, other, failure in CHECKS:
        f = F.expr(failure)
        status = F.when(~F.expr(when), other).when(f.isNull(), "PASS").otherwise("FAIL")
        checks.append(F.struct(F.lit(SCOPES[scope]).alias("scope"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), status.alias("status"), F.when(F.expr(when), f).alias("failure")))
    metrics = []
    for name, top, bottom, one in METRICS:
        a, b = F.expr(top).cast("long"), F.expr(bottom).cast("long")
        good = (a == b) if one else (a == 0)
        value = F.try_divide(a.cast("decimal(20,0)"), b.cast("decimal(20,0)")).cast("decimal(20,12)")
        metrics.append(F.struct(F.lit(name).alias("metric"), a.alias("numerator"), b.alias("denominator"), value.alias("value"), F.when(b == 0, "NOT_APPLICABLE").when(good, "PASS").otherwise("FAIL").alias("status")))
    return wide.select("snapshot", F.array(*checks).alias("checks"), F.array(*metrics).alias("metrics"))


def verdicts(rows: DataFrame) -> DataFrame:
    """REJECTED by a failed check or metric, else INCONCLUSIVE by a skipped one, else VALIDATED; the score is the share of checks passed."""
    n = lambda test: F.size(F.filter("checks", test)).cast("long")
    rows = rows.select(
        "snapshot", n(lambda c: (c["status"] == "FAIL") & (c["severity"] == "BLOCKER")).alias("blockers"), n(lambda c: c["status"] == "PASS").alias("passed"), n(lambda c: c["status"] == "FAIL").alias("failed"),
        n(lambda c: c["status"] == "SKIPPED").alias("skipped"), F.exists("metrics", lambda m: m["status"] == "FAIL").alias("bad"),
    )
    status = F.when((F.col("blockers") > 0) | (F.col("failed") > 0) | F.col("bad"), "REJECTED").when(F.col("skipped") > 0, "INCONCLUSIVE").otherwise("VALIDATED")
    score = F.try_divide((F.col("passed") * 100).cast("decimal(20,0)"), (F.col("passed") + F.col("failed") + F.col("skipped")).cast("decimal(20,0)"))
    return rows.select("snapshot", "blockers", "passed", "failed", "skipped", status.alias("status"), F.coalesce(score, F.lit(0)).cast("decimal(20,6)").alias("score"))


_T = lambda x: f"TIMESTAMP '{x}'"
_IN = f"occurred >= {_T(FROM)} AND occurred < {_T(TO)}"
_INPUTS = f"""b AS (SELECT user_id AS snapshot, event_id AS source, post_id % 6 AS record, ts AS occurred, ts + to_hours((event_id % 50)::INTEGER) AS ingested, 'p' || (event_id % 7) AS print, CASE WHEN event_id % 4 <> 0 THEN 'a' || (event_id % 5) END AS evidence,
        CASE WHEN event_id % 1009 = 0 THEN 'REJECTED' WHEN event_id % 811 = 0 THEN 'CONFLICTED' ELSE 'MAPPED' END AS state, CASE WHEN event_id % 10 = 0 THEN 'subject:' ELSE 'user:' END || user_id AS identity FROM behaviour WHERE kind IN ('click', 'save')),
    captured AS (SELECT * FROM b WHERE {_IN} AND ingested <= {_T(BOUND)}),
    mem AS (SELECT * REPLACE (CASE WHEN source % 709 = 0 THEN occurred + INTERVAL 1 SECOND ELSE occurred END AS occurred) FROM captured),
    src AS (SELECT snapshot, source, occurred, ingested, CASE WHEN k = 1 THEN 'y' WHEN source % 401 = 0 THEN 'x' ELSE print END AS print, evidence, state, identity FROM (SELECT *, unnest(CASE WHEN source % 331 = 0 THEN [0, 0] WHEN source % 431 = 0 THEN [0, 1] ELSE [0] END) AS k FROM b WHERE (({_IN}) OR snapshot % 7 = 2) AND source % 601 <> 3)),
    expe AS (SELECT snapshot, record, count(*) AS n, count(*) || ':' || min(source) || ':' || max(source) AS print FROM captured GROUP BY 1, 2),
    rec0 AS (SELECT snapshot, record, n + CASE WHEN snapshot % 19 = 4 AND record = 1 THEN 1 ELSE 0 END AS n, CASE WHEN snapshot % 47 = 5 AND record = 2 THEN '?' ELSE print END AS print FROM expe WHERE NOT (snapshot % 17 = 3 AND record = 0)),
    rec AS (SELECT *, 'subject:' || snapshot AS subject FROM (SELECT * FROM rec0 UNION ALL SELECT DISTINCT snapshot, 7, 0, '0' FROM rec0 WHERE snapshot % 53 = 6)),
    lin AS (SELECT snapshot, record, source, print, evidence, policy FROM (SELECT snapshot, CASE WHEN snapshot % 23 = 5 AND record = 0 THEN 9 ELSE record END AS record, source, print, CASE WHEN source % 503 = 0 THEN 'z' ELSE evidence END AS evidence, CASE WHEN snapshot % 43 = 9 THEN 'v0' ELSE 'v1' END AS policy,
        unnest(CASE WHEN source % 307 = 0 THEN [0, 0] ELSE [0] END) AS k FROM captured WHERE NOT (snapshot % 59 = 8 AND record = 3))),
    bin0 AS (SELECT user_id AS snapshot, 'user:' || user_id AS identity, 'subject:' || user_id AS target, CASE WHEN user_id % 13 = 6 THEN 1 ELSE 0 END AS w2, CASE WHEN user_id % 61 = 10 THEN 1 ELSE 0 END AS w3, CASE WHEN user_id % 67 = 11 THEN 1 ELSE 0 END AS w4, CASE WHEN user_id % 71 = 12 THEN 1 ELSE 0 END AS w5 FROM members WHERE user_id % 29 <> 7),
    bin AS (SELECT * FROM bin0 UNION ALL SELECT * REPLACE ('subject:other' AS target) FROM bin0 WHERE snapshot % 31 = 8),
    exp0 AS (SELECT snapshot, record FROM expe WHERE snapshot % 2 = 0 AND NOT (snapshot % 16 = 4 AND record = 1)),
    exs AS (SELECT * FROM exp0 UNION ALL SELECT * FROM exp0 WHERE snapshot % 26 = 8 AND record = 2),
    sto AS (SELECT snapshot, s_records + CASE WHEN snapshot % 83 = 15 THEN 1 ELSE 0 END AS s_records, 1 AS s_subjects, s_sources, s_content, s_lineage, snapshot % 79 <> 14 AS s_as_of, CASE WHEN snapshot % 73 = 13 THEN 'REJECTED' ELSE 'CREATED' END AS s_status, snapshot % 2 = 0 AS outcome
        FROM (SELECT snapshot, count(*) AS s_records, {sql_fold(sql_text('record', 'n', 'print'))} AS s_content FROM expe GROUP BY 1) JOIN (SELECT snapshot, count(DISTINCT source) AS s_sources, {sql_fold(sql_text('record', 'source', 'print', 'evidence', "'v1'"))} AS s_lineage FROM captured GROUP BY 1) USING (snapshot))"""
_HAS = "EXISTS (SELECT 1 FROM src s WHERE s.snapshot = l.snapshot AND s.source = l.source AND s.print = l.print)"
_MEASURED = f"""{_INPUTS},
    acc AS (SELECT snapshot, source, count(DISTINCT (print, evidence, occurred, ingested, state)) AS kinds, min(print) AS print, min((occurred, ingested)) AS times, min(state) AS state FROM src WHERE {_IN} AND ingested <= {_T(BOUND)} GROUP BY 1, 2),
    both_ AS (SELECT coalesce(m.snapshot, a.snapshot) AS snapshot, coalesce(m.source, a.source) AS source, m.source IS NOT NULL AS has_m, a.source IS NOT NULL AS has_a, m.print AS mp, a.print AS ap, kinds, (m.occurred, m.ingested) <> a.times AS moved, a.state FROM mem m FULL JOIN acc a ON m.snapshot = a.snapshot AND m.source = a.source),
    sa AS (SELECT snapshot, count(*) FILTER (WHERE has_m) AS m_count, count(*) FILTER (WHERE has_a) AS a_count, count(*) FILTER (WHERE has_m AND NOT has_a) AS missing, count(*) FILTER (WHERE has_a AND NOT has_m) AS unexpected, count(*) FILTER (WHERE kinds > 1) AS conflicting, count(*) FILTER (WHERE has_m AND has_a AND moved) AS wrong_time,
        count(*) FILTER (WHERE has_m AND state = 'REJECTED') AS rejected, count(*) FILTER (WHERE has_m AND state = 'CONFLICTED') AS conflicted, {sql_fold("CASE WHEN has_m THEN " + sql_text('source', 'mp') + " END")} AS m_print, {sql_fold("CASE WHEN has_a THEN " + sql_text('source', 'ap') + " END")} AS a_print FROM both_ GROUP BY 1),
    sb AS (SELECT snapshot, count(*) AS n_sources, count(*) FILTER (WHERE NOT ({_IN})) AS out_of_range, count(*) FILTER (WHERE {_IN} AND ingested > {_T(BOUND)}) AS late FROM src GROUP BY 1),
    lf AS (SELECT l.*, {_HAS} AS found, EXISTS (SELECT 1 FROM src s WHERE s.snapshot = l.snapshot AND s.source = l.source) AS present, EXISTS (SELECT 1 FROM src s WHERE s.snapshot = l.snapshot AND s.source = l.source AND s.print = l.print AND s.evidence IS NOT DISTINCT FROM l.evidence) AS whole FROM lin l),
    la AS (SELECT snapshot, count(*) AS l_rows, count(DISTINCT source) AS l_sources, count(DISTINCT source) FILTER (WHERE NOT found AND present) AS l_changed, count(DISTINCT source) FILTER (WHERE NOT found) AS l_lost, count(DISTINCT source) FILTER (WHERE found AND NOT whole) AS l_evidence FROM lf GROUP BY 1),
    lb AS (SELECT snapshot, sum(n - 1)::BIGINT AS l_repeats, count(*) FILTER (WHERE policy <> 'v1') AS l_policy, {sql_fold(sql_text('record', 'source', 'print', 'evidence', 'policy'))} AS l_print FROM (SELECT snapshot, record, source, print, evidence, policy, count(*) AS n FROM lin GROUP BY ALL) GROUP BY 1),
    ra AS (SELECT snapshot, count(*) AS r_rows, count(DISTINCT record) AS r_count, count(DISTINCT subject) AS subjects, {sql_fold(sql_text('record', 'n', 'print'))} AS r_print, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lin l WHERE l.snapshot = rec.snapshot AND l.record = rec.record)) AS r_bare FROM rec GROUP BY 1),
    rb AS (SELECT coalesce(r.snapshot, e.snapshot) AS snapshot, count(e.record) AS e_count, count(*) FILTER (WHERE r.record IS NULL) AS r_missing, count(*) FILTER (WHERE e.record IS NULL) AS r_unexpected, count(*) FILTER (WHERE r.n <> e.n) AS r_count_diff, count(*) FILTER (WHERE r.n <> e.n OR r.print <> e.print) AS r_print_diff FROM rec r FULL JOIN expe e ON r.snapshot = e.snapshot AND r.record = e.record GROUP BY 1),
    rc AS (SELECT snapshot, {sql_fold(sql_text('record', 'n', 'print'))} AS e_print FROM expe GROUP BY 1),
    lo AS (SELECT snapshot, count(*) AS l_orphans FROM lin l WHERE NOT EXISTS (SELECT 1 FROM rec r WHERE r.snapshot = l.snapshot AND r.record = l.record) GROUP BY 1),
    need AS (SELECT DISTINCT l.snapshot, s.identity FROM lf l JOIN src s ON s.snapshot = l.snapshot AND s.source = l.source WHERE l.found AND s.identity LIKE 'user:%'),
    idf AS (SELECT n.snapshot, n.identity, count(b.target) AS bound, CASE WHEN count(b.target) = 0 THEN 0 WHEN count(DISTINCT b.target) > 1 THEN 1 WHEN max(w2) = 1 THEN 2 WHEN max(w3) = 1 THEN 3 WHEN max(w4) = 1 THEN 4 WHEN max(w5) = 1 THEN 5 END AS f FROM need n LEFT JOIN bin b ON b.snapshot = n.snapshot AND b.identity = n.identity GROUP BY 1, 2),
    ia AS (SELECT snapshot, count(*) AS i_required, count(*) FILTER (WHERE bound = 1 AND f IS NULL) AS i_valid, min(f) AS i_failure FROM idf GROUP BY 1),
    xf AS (SELECT r.snapshot, r.record, CASE WHEN count(x.record) = 0 THEN 0 WHEN count(x.record) > 1 THEN 1 WHEN r.snapshot % 14 = 6 THEN 2 WHEN r.snapshot % 22 = 10 THEN 3 WHEN r.snapshot % 34 = 12 THEN 4 WHEN r.snapshot % 38 = 14 THEN 5 WHEN r.snapshot % 46 = 16 THEN 6 WHEN r.snapshot % 58 = 18 THEN 7 END AS f FROM rec r LEFT JOIN exs x ON x.snapshot = r.snapshot AND x.record = r.record GROUP BY 1, 2),
    xa AS (SELECT snapshot, count(*) AS x_required, count(*) FILTER (WHERE f IS NULL) AS x_valid, min(f) AS x_failure FROM xf GROUP BY 1),
    wide0 AS (SELECT * FROM sto LEFT JOIN sa USING (snapshot) LEFT JOIN sb USING (snapshot) LEFT JOIN la USING (snapshot) LEFT JOIN lb USING (snapshot) LEFT JOIN ra USING (snapshot) LEFT JOIN rb USING (snapshot) LEFT JOIN rc USING (snapshot) LEFT JOIN lo USING (snapshot) LEFT JOIN ia USING (snapshot) LEFT JOIN xa USING (snapshot)),
    wide AS (SELECT * REPLACE (coalesce(l_orphans, 0) AS l_orphans, coalesce(l_rows, 0) AS l_rows, coalesce(l_sources, 0) AS l_sources, coalesce(l_changed, 0) AS l_changed, coalesce(l_lost, 0) AS l_lost, coalesce(l_evidence, 0) AS l_evidence, coalesce(l_repeats, 0) AS l_repeats, coalesce(l_policy, 0) AS l_policy, coalesce(l_print, '{_EMPTY}') AS l_print, coalesce(r_rows, 0) AS r_rows,
        coalesce(r_count, 0) AS r_count, coalesce(r_print, '{_EMPTY}') AS r_print, coalesce(r_bare, 0) AS r_bare, coalesce(subjects, 0) AS subjects, coalesce(i_required, 0) AS i_required, coalesce(i_valid, 0) AS i_valid, coalesce(x_required, 0) AS x_required, coalesce(x_valid, 0) AS x_valid, coalesce(n_sources, 0) AS n_sources, coalesce(out_of_range, 0) AS out_of_range, coalesce(late, 0) AS late) FROM wide0),
    checks AS ({" UNION ALL ".join(f"SELECT snapshot, '{SCOPES[s]}' AS scope, '{c}' AS code, '{v}' AS severity, CASE WHEN NOT ({w}) THEN '{o}' WHEN ({f}) IS NULL THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN {w} THEN {f} END AS failure FROM wide" for s, c, v, w, o, f in CHECKS)}),
    ratios AS ({" UNION ALL ".join(f"SELECT snapshot, '{m}' AS metric, ({a})::BIGINT AS numerator, ({b})::BIGINT AS denominator, {str(one).lower()} AS one FROM wide" for m, a, b, one in METRICS)}),
    metrics AS (SELECT snapshot, metric, numerator, denominator, round(numerator / nullif(denominator, 0), 12) AS value, CASE WHEN denominator = 0 THEN 'NOT_APPLICABLE' WHEN CASE WHEN one THEN numerator = denominator ELSE numerator = 0 END THEN 'PASS' ELSE 'FAIL' END AS status FROM ratios)"""


@query("snapshot_checks", f"WITH {_MEASURED} SELECT * FROM checks", ("behaviour", "members"))
def snapshot_checks(d: Domain) -> DataFrame:
    return checked(measures(Inputs(d))).select("snapshot", F.inline("checks"))


@query("snapshot_metrics", f"WITH {_MEASURED} SELECT * FROM metrics", ("behaviour", "members"))
def snapshot_metrics(d: Domain) -> DataFrame:
    return checked(measures(Inputs(d))).select("snapshot", F.inline("metrics"))


@query("snapshot_anomalies", f"WITH {_MEASURED} SELECT failure, severity, count(*) AS n, min(snapshot) AS first FROM checks WHERE status = 'FAIL' GROUP BY 1, 2", ("behaviour", "members"))
def snapshot_anomalies(d: Domain) -> DataFrame:
    """Failed checks by what failed, over all snapshots."""
    rows = snapshot_checks(d).filter("status = 'FAIL'")
    return rows.groupBy("failure", "severity").agg(F.count("*").alias("n"), F.min("snapshot").alias("first"))


@query(
    "snapshot_verdicts",
    f"""WITH {_MEASURED}, v AS (SELECT snapshot, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'BLOCKER') AS blockers, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'SKIPPED') AS skipped FROM checks GROUP BY 1),
    w AS (SELECT snapshot, bool_or(status = 'FAIL') AS bad FROM metrics GROUP BY 1)
    SELECT snapshot, blockers, passed, failed, skipped, CASE WHEN failed > 0 OR bad THEN 'REJECTED' WHEN skipped > 0 THEN 'INCONCLUSIVE' ELSE 'VALIDATED' END AS status, round(100.0 * passed / (passed + failed + skipped), 6) AS score FROM v JOIN w USING (snapshot)""",
    ("behaviour", "members"),
)
def snapshot_verdicts(d: Domain) -> DataFrame:
    return verdicts(checked(measures(Inputs(d))))


_PARTS = "SELECT user_id, post_id, kind, count(*) AS n, max(event_id) AS last FROM behaviour {where} GROUP BY 1, 2, 3"
_PRINT = sql_fold(sql_text("post_id", "kind", "n", "last"))


@query(
    "rebuild_fingerprints",
    f"""WITH a AS (SELECT user_id, {_PRINT} AS print FROM ({_PARTS.format(where="")}) GROUP BY 1), b AS (SELECT user_id, {_PRINT} AS print FROM ({_PARTS.format(where="WHERE event_id % 499 <> 0")}) GROUP BY 1)
    SELECT user_id, a.print AS print, coalesce(b.print, '{_EMPTY}') AS rebuilt, a.print = coalesce(b.print, '{_EMPTY}') AS matched FROM a LEFT JOIN b USING (user_id)""",
    ("behaviour",),
)
def rebuild_fingerprints(d: Domain) -> DataFrame:
    """A member's projection beside one rebuilt from daily parts of sources of which some are lost (P17): order-free fingerprints, so that neither the
    partitions nor the order of the two builds count, and every lost row does. Both sides meet in one grouping."""
    key = ["user_id", "post_id", "kind"]
    whole = d.behaviour.groupBy(*key).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    daily = d.behaviour.filter("event_id % 499 <> 0").groupBy(*key, F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    again = daily.groupBy(*key).agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    hashed = row_hash(row_text("post_id", "kind", "n", "last"))
    both = _tagged(a=whole, b=again).groupBy("user_id").agg(fold(_of("a", hashed)).alias("print"), fold(_of("b", hashed)).alias("rebuilt"))
    return both.withColumn("matched", F.col("print") == F.col("rebuilt"))
