"""Outcomes of exposures projected from sources, each exposure with its first failure or its record and lineage.

Exposures are views, their sources the view itself and the behaviour that follows it, with defects planted by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fingerprint import fold, row_hash, row_text, sql_fold, sql_text
from ..operators.joins import as_of
from ..operators.keyed import join_counted
from ..sources.sinks import stage
from ..sources.tables import Domain
from .registry import query

# The schema, the authority of exposures, types of sources and the days of a window.
SCHEMA, AUTHORITY = "experiment-outcome-input-v1", "recommendation_p2_experiment_exposure"
EXPOSURE_TYPE, OUTCOME_TYPES, DAYS = "experiment_exposure", ("recommendation_click", "post_like", "post_bookmark", "post_share"), 7
# What an exposure can fail on before its sources are read one by one, in order; (code, field, detail, condition).
BEFORE = (
    ("unsupported_projection_schema", "definition", "outcome_schema", f"schema is null or schema <> '{SCHEMA}'"),
    ("exposure_binding_missing", "exposure", "missing", "bound is null"),
    ("exposure_binding_invalid", "exposure", "authority", f"authority is null or authority <> '{AUTHORITY}'"),
    ("identity_binding_required", "identity", "binding_required", "identity_source is null"),
    ("identity_binding_invalid", "identity", "exposure_binding", "identity_source <> source_user or not (identity_subject <=> subject) or not (identity_version <=> version)"),
    ("source_checkpoint_invalid", "checkpoint", "source_set", "coalesce(found_n, 0) = 0 or not (found_n <=> checkpoint_n) or not (found_print <=> checkpoint_print) or not (found_last <=> checkpoint_last)"),
    ("exposure_binding_invalid", "projectionAsOf", "before_exposure", "as_of < exposed_at"),
    ("projection_invariant_failed", "source", "duplicate_conflict", "conflicts > 0"),
)
# What a source can fail on, in order.
_OUTCOME = f"type in {OUTCOME_TYPES}"
PER_SOURCE = (
    ("unsupported_source_schema", "source", "schema_version", "not (contract <=> source_contract)"),
    ("source_fingerprint_mismatch", "source", "fingerprint", "not (sha2(form, 256) <=> print)"),
    ("source_checkpoint_invalid", "occurredAt", "future_event", "occurred_at >= as_of"),
    ("adapter_evidence_conflicted", "adapter", "conflicted", "state = 'CONFLICTED'"),
    ("adapter_evidence_rejected", "adapter", "rejected", "state = 'REJECTED'"),
    ("unsupported_source_schema", "adapter", "unsupported", "state = 'UNSUPPORTED'"),
    ("identity_namespace_conflict", "identity", "subject_mismatch", "not (subject <=> case when identity like 'subject:%' then identity when identity = identity_source then identity_subject end)"),
    ("exposure_binding_invalid", "exposure", "source_mismatch", f"type = '{EXPOSURE_TYPE}' and (not (of_exposure <=> exposure) or not (of_variant <=> variant) or not (occurred_at <=> exposed_at))"),
    ("exposure_binding_invalid", "outcome", "binding_mismatch", f"{_OUTCOME} and (not (of_exposure <=> exposure) or not (of_variant <=> variant) or not (of_session <=> session))"),
    ("outcome_window_violation", "outcome", "outside_window", f"{_OUTCOME} and (occurred_at < exposed_at or occurred_at >= exposed_at + make_dt_interval({DAYS}))"),
)
UNSEEN = ("exposure_binding_missing", "exposure", "source_missing")
FAILURES = (*BEFORE, *PER_SOURCE, UNSEEN)
#: What tells one delivered source from another: repeats of all of these are one source if all else is equal, too.
IDENTITY = ["exposure", "ref", "print", "evidence"]
SET = ["ref", "print", "evidence", "occurred", "ingested"]


def _first(checks: tuple, at: int) -> Column:
    """The number of the first of the checks that fails; they are numbers at, at + 1 and so on of FAILURES."""
    return F.coalesce(*(F.when(F.expr(c), at + i) for i, (*_, c) in enumerate(checks)))


def within(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds included: the source is in its exposure's span of time and was taken in by the bound. ends: one row per exposure, read twice."""
    sizes = rows.groupBy("exposure").agg(F.count("*").alias("deliveries"))
    keyed = stage(sizes.join(ends, "exposure").select("exposure", "deliveries", "starts", "ends", "ingested_until"), "spans")
    total = keyed.agg(F.coalesce(F.sum("deliveries"), F.lit(0)).alias("n")).first()["n"]
    met = join_counted(rows, keyed, ["exposure"], "deliveries", total)
    inside = (F.col("occurred_at") >= F.col("starts")) & (F.col("occurred_at") < F.col("ends")) & (F.col("ingested_at") <= F.col("ingested_until"))
    return met.select(*rows.columns, F.coalesce(inside, F.lit(False)).alias("included"))


def checkpoint_of(included: DataFrame) -> DataFrame:
    """(exposure, n, print, last) of each exposure's set of included sources; repeats count once, and the print knows no order."""
    each = included.filter("included").select("exposure", "ref", "print", "evidence", F.unix_micros("occurred_at").alias("occurred"), F.unix_micros("ingested_at").alias("ingested")).distinct()
    hashed = row_hash(row_text(*SET))
    return each.groupBy("exposure").agg(F.count("*").alias("n"), fold(hashed).alias("set_print"), F.max(F.struct("occurred", "ref"))["ref"].alias("last"))


def project_outcomes(bindings: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, lineage) of exposures.

    bindings: one row per exposure with schema, authority, source_user, subject, version, variant, session, exposed_at, as_of, source_contract,
    identity_source, identity_subject, identity_version, starts, ends, ingested_until, checkpoint_n, checkpoint_print, checkpoint_last.
    sources: exposure, ref, print, form, evidence, state, type, identity, of_exposure, of_variant, of_session, contract, occurred_at, ingested_at; in any
    number of deliveries. Sources of an exposure without a binding give a record that says so.

    A record has the code, field and detail of its first failure, in the order of FAILURES and, among sources, of (ref, print, evidence); where there is
    none, these are null and it has flags, counts and the print of its lineage. Lineage holds one row per source of a record without failure.
    Deliveries are folded to sources before they meet their exposure, and exposures with many sources are joined by a broadcast: no exposure's
    sources are ever a list."""
    bindings = stage(bindings.withColumn("bound", F.lit(True)), "bindings")
    sources = stage(sources, "sources")
    included = stage(within(sources, bindings), "included")
    found = checkpoint_of(included).select("exposure", F.col("n").alias("found_n"), F.col("set_print").alias("found_print"), F.col("last").alias("found_last"))
    # one row per source; two deliveries of it that differ are a conflict
    rest = [c for c in sources.columns if c not in IDENTITY]
    delivered = row_hash(row_text(*(c for c in sources.columns if c not in ("occurred_at", "ingested_at")), "occurred", "ingested"))
    hashed = included.withColumns({"occurred": F.unix_micros("occurred_at"), "ingested": F.unix_micros("ingested_at")}).withColumn("_h", delivered)
    once = hashed.groupBy(*IDENTITY).agg(F.min("_h").alias("_lo"), F.max("_h").alias("_hi"), F.max("included").alias("_in"), F.min_by(F.struct(*rest), "_h").alias("_row"))
    same = Window.partitionBy("exposure", "ref", "print")
    once = once.withColumn("_in", F.max("_in").over(same)).filter("_in").select(*IDENTITY, "_row.*", (F.col("_lo") != F.col("_hi")).alias("conflict"))
    once = stage(once, "once")
    n = once.groupBy("exposure").agg(F.count("*").alias("n_once"), F.count_if("conflict").alias("conflicts"))
    strays = sources.select("exposure").distinct().join(bindings.select("exposure"), "exposure", "left_anti")
    schema = bindings.agg(F.max("schema").alias("schema"))
    if strays.limit(1).count():  # a definition is one for the projection: exposures without a binding are judged under it, too
        bindings = bindings.unionByName(strays.withColumn("schema", F.lit(schema.first()["schema"] or SCHEMA)), allowMissingColumns=True)
    judged = bindings.join(found, "exposure", "left").join(n, "exposure", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("conflicts", "n_once")})
    judged = stage(judged.withColumn("before", _first(BEFORE, 0)), "judged")
    ready = judged.filter("before is null").drop("bound", "before", "conflicts", "found_n", "found_print", "found_last", "schema")
    total = ready.agg(F.coalesce(F.sum("n_once"), F.lit(0)).alias("n")).first()["n"]
    seen = join_counted(once.drop("conflict"), ready, ["exposure"], "n_once", total).withColumn("failed", _first(PER_SOURCE, len(BEFORE)))
    counted = F.col("type").isin(EXPOSURE_TYPE, *OUTCOME_TYPES)
    per = seen.groupBy("exposure").agg(
        F.min(F.when(F.col("failed").isNotNull(), F.struct("ref", "print", "evidence", "failed")))["failed"].alias("failed"),
        F.bool_or(F.col("type") == EXPOSURE_TYPE).alias("shown"),
        *(F.bool_or(F.col("type") == t).alias(name) for t, name in zip(OUTCOME_TYPES, ("clicked", "liked", "saved", "shared"))),
        F.count_if(F.col("type").isin(*OUTCOME_TYPES)).alias("n_outcomes"), F.count_if(counted).alias("n_sources"),
        fold(F.when(counted, row_hash(row_text("ref", "print", "evidence")))).alias("lineage_print"),
    )
    per = stage(per, "projected")
    number = F.coalesce("before", "failed", F.when(~F.coalesce("shown", F.lit(False)), len(FAILURES) - 1))
    whole = ("clicked", "liked", "saved", "shared", "n_outcomes", "n_sources", "lineage_print")
    texts = [F.when(F.col("number").isNotNull(), F.element_at(F.array(*(F.lit(f[k]) for f in FAILURES)), F.col("number") + 1)).alias(name) for k, name in enumerate(("code", "field", "detail"))]
    ended = judged.join(per, "exposure", "left").withColumn("number", number)
    records = ended.select("exposure", *texts, *(F.when(F.col("number").isNull(), F.col(c)).alias(c) for c in whole))
    good = per.filter("failed is null and shown").select("exposure", F.col("n_sources").alias("_n"))
    lineage = join_counted(once.filter(counted), good, ["exposure"], "_n", total).select("exposure", "ref", "print", "evidence", "type")
    return records, lineage


_KINDS = "CASE WHEN kind = 'click' THEN 'recommendation_click' WHEN kind = 'save' AND event_id % 2 = 0 THEN 'post_like' WHEN kind = 'save' THEN 'post_bookmark' WHEN kind = 'report' AND event_id % 2 = 0 THEN 'post_share' ELSE 'post_view' END"
#: The tables' sources: (name, expression in both dialects) over exposure, user_id, n, type, occurred_at.
_FIELDS = {
    "ref": "concat('e', n)", "form": "concat('e', n, '|', type)", "evidence": "CASE WHEN n % 7 <> 0 THEN concat('a', n) END",
    "state": "CASE WHEN n % 193 = 0 THEN 'CONFLICTED' WHEN n % 191 = 0 THEN 'REJECTED' WHEN n % 181 = 0 THEN 'UNSUPPORTED' ELSE 'MAPPED' END",
    "identity": "CASE WHEN n % 179 = 0 THEN 'subject:other' WHEN n % 3 = 0 THEN concat('subject:', user_id) ELSE concat('user:', user_id) END",
    "of_exposure": "exposure", "of_variant": "CASE WHEN n % 173 = 0 THEN 'v9' ELSE concat('v', exposure % 2) END", "of_session": "CASE WHEN n % 167 = 0 THEN 'other' ELSE concat('s', exposure) END",
    "contract": "CASE WHEN n % 199 = 0 THEN 'p0-v0' ELSE 'p0-v1' END",
}
_BOUND = {
    "schema": f"CASE WHEN exposure % 83 = 0 THEN 'experiment-outcome-input-v0' ELSE '{SCHEMA}' END", "authority": f"CASE WHEN exposure % 79 = 0 THEN 'another' ELSE '{AUTHORITY}' END",
    "source_user": "concat('user:', user_id)", "subject": "concat('subject:', user_id)", "version": "'b1'", "variant": "concat('v', exposure % 2)", "session": "concat('s', exposure)",
    "source_contract": "'p0-v1'", "identity_source": "CASE WHEN exposure % 73 = 0 THEN NULL WHEN exposure % 71 = 0 THEN 'user:none' ELSE concat('user:', user_id) END",
    "identity_subject": "concat('subject:', user_id)", "identity_version": "CASE WHEN exposure % 67 = 0 THEN 'b0' ELSE 'b1' END",
    "as_of": "CASE WHEN exposure % 61 = 0 THEN exposed_at - INTERVAL 1 HOUR WHEN exposure % 59 = 0 THEN exposed_at + INTERVAL 1 HOUR ELSE exposed_at + INTERVAL 60 DAY END",
    "starts": "exposed_at", "ends": "exposed_at + INTERVAL 40 DAY", "ingested_until": "exposed_at + INTERVAL 41 DAY",
}


def source_rows(d: Domain) -> tuple[DataFrame, DataFrame]:
    """(bindings without a checkpoint, sources) of the tables."""
    shown = d.behaviour.filter("kind = 'view'").select(F.col("event_id").alias("exposure"), "user_id", (F.col("post_id") % 10).alias("entity"), F.col("ts").alias("exposed_at"))
    acts = d.behaviour.filter("kind in ('click', 'save', 'report')").select("event_id", "user_id", (F.col("post_id") % 10).alias("entity"), "ts", F.expr(_KINDS).alias("type"))
    bound = as_of(acts, shown, ["user_id", "entity"], "ts", "exposed_at", "exposure").filter("exposure is not null")
    rows = shown.filter("exposure % 53 <> 0").select("exposure", "user_id", F.col("exposure").alias("n"), F.lit(EXPOSURE_TYPE).alias("type"), F.col("exposed_at").alias("occurred_at"))
    rows = rows.unionByName(bound.select("exposure", "user_id", F.col("event_id").alias("n"), "type", F.col("ts").alias("occurred_at")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr("case when n % 13 = 0 or n % 163 = 0 then 1 else 0 end")))).withColumns({k: F.expr(v) for k, v in _FIELDS.items()})
    late = F.timestamp_micros(F.unix_micros("occurred_at") + (F.col("n") % 5 + F.when(F.col("n") % 163 == 0, F.col("copy")).otherwise(0)) * 1_000_000)
    rows = rows.withColumns({"print": F.when(F.col("n") % 211 == 0, F.sha2(F.concat("form", F.lit("!")), 256)).otherwise(F.sha2("form", 256)), "ingested_at": late})
    bindings = shown.filter("exposure % 89 <> 0").select("exposure", "exposed_at", *(F.expr(v).alias(k) for k, v in _BOUND.items()))
    return bindings, rows.drop("user_id", "copy")


def _projected(d: Domain) -> tuple[DataFrame, DataFrame]:
    """The tables' exposures; their checkpoints were taken before sources with numbers divisible by 149 were known."""
    bindings, rows = source_rows(d)
    rows = stage(rows, "rows")
    known = checkpoint_of(within(rows.filter("n % 149 <> 0"), bindings)).select("exposure", F.col("n").alias("checkpoint_n"), F.col("set_print").alias("checkpoint_print"), F.col("last").alias("checkpoint_last"))
    return project_outcomes(bindings.join(known, "exposure", "left"), rows.drop("n"))


def _case(checks: tuple, at: int) -> str:
    """The checks as one CASE of DuckDB."""
    def plain(c: str) -> str:
        return c.replace("sha2(form, 256)", "sha256(form)").replace(" <=> ", " IS NOT DISTINCT FROM ").replace(f"make_dt_interval({DAYS})", f"INTERVAL {DAYS} DAY")

    return "CASE " + " ".join(f"WHEN {plain(c)} THEN {at + i}" for i, (*_, c) in enumerate(checks)) + " END"


_COUNTS = "SELECT exposure, count(*) AS n, {fold} AS set_print, arg_max(ref, (occurred, ref)) AS last FROM (SELECT DISTINCT exposure, ref, print, evidence, epoch_us(occurred_at) AS occurred, epoch_us(ingested_at) AS ingested FROM inside WHERE included{known}) GROUP BY 1"
_SQL = f"""WITH x AS (SELECT event_id AS exposure, user_id, post_id % 10 AS entity, ts AS exposed_at FROM behaviour WHERE kind = 'view'),
    o AS (SELECT event_id, user_id, post_id % 10 AS entity, ts, {_KINDS} AS type FROM behaviour WHERE kind IN ('click', 'save', 'report')),
    j AS (SELECT x.exposure, o.user_id, o.event_id AS n, o.type, o.ts AS occurred_at, row_number() OVER (PARTITION BY o.event_id ORDER BY x.exposed_at DESC, x.exposure DESC) AS nth FROM o JOIN x ON x.user_id = o.user_id AND x.entity = o.entity AND x.exposed_at <= o.ts),
    r AS (SELECT exposure, user_id, exposure AS n, '{EXPOSURE_TYPE}' AS type, exposed_at AS occurred_at FROM x WHERE exposure % 53 <> 0 UNION ALL SELECT exposure, user_id, n, type, occurred_at FROM j WHERE nth = 1),
    s AS (SELECT r.*, {', '.join(f'{v} AS {k}' for k, v in _FIELDS.items())}, copy FROM r, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR n % 13 = 0 OR n % 163 = 0),
    src AS (SELECT *, CASE WHEN n % 211 = 0 THEN sha256(form || '!') ELSE sha256(form) END AS print, make_timestamp(epoch_us(occurred_at) + (n % 5 + CASE WHEN n % 163 = 0 THEN copy ELSE 0 END) * 1000000) AS ingested_at FROM s),
    b AS (SELECT exposure, exposed_at, {', '.join(f'{v} AS {k}' for k, v in _BOUND.items())} FROM x WHERE exposure % 89 <> 0),
    inside AS (SELECT src.*, occurred_at >= starts AND occurred_at < ends AND ingested_at <= ingested_until AS included FROM src JOIN b USING (exposure)),
    cp AS ({_COUNTS.format(fold=sql_fold(sql_text(*SET)), known=' AND n % 149 <> 0')}), fd AS ({_COUNTS.format(fold=sql_fold(sql_text(*SET)), known='')}),
    picked AS (SELECT i.* FROM inside i WHERE EXISTS (SELECT 1 FROM inside k WHERE k.included AND k.exposure = i.exposure AND k.ref = i.ref AND k.print = i.print)),
    once AS (SELECT exposure, ref, print, evidence, count(DISTINCT (ingested_at, occurred_at)) AS versions, any_value(form) AS form, any_value(state) AS state, any_value(type) AS type, any_value(identity) AS identity, any_value(of_exposure) AS of_exposure,
        any_value(of_variant) AS of_variant, any_value(of_session) AS of_session, any_value(contract) AS contract, any_value(occurred_at) AS occurred_at FROM picked GROUP BY 1, 2, 3, 4),
    nn AS (SELECT exposure, count(*) FILTER (WHERE versions > 1) AS conflicts FROM once GROUP BY 1),
    jd AS (SELECT b.*, TRUE AS bound, fd.n AS found_n, fd.set_print AS found_print, fd.last AS found_last, cp.n AS checkpoint_n, cp.set_print AS checkpoint_print, cp.last AS checkpoint_last, coalesce(conflicts, 0) AS conflicts
        FROM b LEFT JOIN fd USING (exposure) LEFT JOIN cp USING (exposure) LEFT JOIN nn USING (exposure)),
    pre AS (SELECT *, {_case(BEFORE, 0)} AS before FROM jd),
    seen AS (SELECT once.*, {_case(PER_SOURCE, len(BEFORE))} AS failed FROM once JOIN (SELECT * EXCLUDE (schema) FROM pre WHERE before IS NULL) p USING (exposure)),
    per AS (SELECT exposure, arg_min(failed, (ref, print, coalesce(evidence, ''))) FILTER (WHERE failed IS NOT NULL) AS failed, bool_or(type = '{EXPOSURE_TYPE}') AS shown,
        {', '.join(f"bool_or(type = '{t}') AS {c}" for t, c in zip(OUTCOME_TYPES, ('clicked', 'liked', 'saved', 'shared')))}, count(*) FILTER (WHERE type IN {OUTCOME_TYPES}) AS n_outcomes,
        count(*) FILTER (WHERE type IN {(EXPOSURE_TYPE, *OUTCOME_TYPES)}) AS n_sources, {sql_fold(f"CASE WHEN type IN {(EXPOSURE_TYPE, *OUTCOME_TYPES)} THEN " + sql_text('ref', 'print', 'evidence') + ' END')} AS lineage_print FROM seen GROUP BY 1),
    done AS (SELECT exposure, coalesce(before, failed, CASE WHEN NOT coalesce(shown, FALSE) THEN {len(FAILURES) - 1} END) AS number, per.* EXCLUDE (exposure, failed, shown) FROM pre LEFT JOIN per USING (exposure)
        UNION ALL SELECT DISTINCT exposure, 1, NULL::BOOLEAN, NULL::BOOLEAN, NULL::BOOLEAN, NULL::BOOLEAN, NULL::BIGINT, NULL::BIGINT, NULL FROM src WHERE exposure NOT IN (SELECT exposure FROM b))"""
_TEXTS = ", ".join(f"({[f[k] for f in FAILURES]})[number + 1] AS {name}" for k, name in enumerate(("code", "field", "detail")))
_WHOLE = ", ".join(f"CASE WHEN number IS NULL THEN {c} END AS {c}" for c in ("clicked", "liked", "saved", "shared", "n_outcomes", "n_sources", "lineage_print"))


@query("outcome_projection", f"{_SQL} SELECT exposure, {_TEXTS}, {_WHOLE} FROM done", ("behaviour",))
def outcome_projection(d: Domain) -> DataFrame:
    """Each exposure's outcomes, or the first reason why it has no record."""
    return _projected(d)[0]


@query(
    "outcome_lineage",
    f"{_SQL} SELECT exposure, ref, print, evidence, type FROM once JOIN done USING (exposure) WHERE number IS NULL AND type IN {(EXPOSURE_TYPE, *OUTCOME_TYPES)}",
    ("behaviour",),
)
def outcome_lineage(d: Domain) -> DataFrame:
    """The sources behind each record."""
    return _projected(d)[1]
