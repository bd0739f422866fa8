"""Metrics, checks and work outcomes of the data platform. Projection runs are orders by priority, their evidence is lines;
failed attempts are events of a (member, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import NOW, Domain, now, stamp
from .events import as_of, exposures, outcomes
from .registry import query

_METRIC = "metric_name, projection, dimension_value, metric_value, metric_timestamp"
_AGE = f"CAST(floor(epoch(TIMESTAMP '{NOW}') - epoch(min(created))) AS BIGINT)"


@query(
    "projection_metrics",
    f"""WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS projection, o_custkey AS subject, o_orderdate AS created, CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'O' THEN 'built' ELSE 'rejected' END AS status FROM orders),
    l AS (SELECT l_orderkey AS id, l_linestatus AS status, CASE WHEN l_returnflag = 'R' THEN 'RETURNED' END AS failure FROM lineitem),
    n AS (SELECT id, count(*) AS records, count(*) FILTER (WHERE failure IS NULL) AS sources FROM l GROUP BY id), s AS (SELECT r.*, coalesce(records, 0) AS records, coalesce(sources, 0) AS sources FROM r LEFT JOIN n USING (id)),
    m({_METRIC}) AS (SELECT 'run_count', projection, NULL, count(*), NULL::TIMESTAMP FROM s GROUP BY projection
    UNION ALL SELECT 'run_status_count', projection, l.status, count(*), NULL FROM r JOIN l USING (id) GROUP BY projection, l.status
    UNION ALL SELECT 'snapshot_status_count', projection, status, count(*), NULL FROM s GROUP BY projection, status
    UNION ALL SELECT 'snapshot_record_count', projection, NULL, sum(records)::BIGINT, NULL FROM s GROUP BY projection
    UNION ALL SELECT 'snapshot_subject_count', projection, NULL, count(DISTINCT subject), NULL FROM s GROUP BY projection
    UNION ALL SELECT 'snapshot_source_event_count', projection, NULL, sum(sources)::BIGINT, NULL FROM s GROUP BY projection
    UNION ALL SELECT 'failure_code_count', projection, failure, count(*), NULL FROM r JOIN l USING (id) WHERE failure IS NOT NULL GROUP BY projection, failure
    UNION ALL SELECT 'conflict_count', 'all', status, count(*), NULL FROM s WHERE records = 0 GROUP BY status
    UNION ALL SELECT 'oldest_unvalidated_snapshot_age_seconds', projection, NULL, {_AGE}, min(created) FROM s WHERE status <> 'validated' GROUP BY projection
    UNION ALL SELECT 'latest_validated_snapshot_time', projection, NULL, NULL, max(created) FROM s WHERE status = 'validated' GROUP BY projection)
    SELECT * FROM m""",
)
def projection_metrics(d: Domain) -> DataFrame:
    """Ten aggregates as rows: lines are folded to their order once, orders to (projection, status) once, and the rest reads these few rows."""
    lines = d.table("lineitem").withColumn("failed", F.col("l_returnflag") == "R")
    per_run = lines.groupBy(F.col("l_orderkey").alias("id"), "l_linestatus").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
    per_run = per_run.groupBy("id").agg(F.sum("n").alias("records"), F.sum("failed").alias("failed"), F.map_from_entries(F.collect_list(F.struct("l_linestatus", "n"))).alias("by_status"))
    status = F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "O", "built").otherwise("rejected")
    runs = d.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("projection"), F.col("o_custkey").alias("subject"), stamp("o_orderdate").alias("at"), status.alias("status"))
    s = runs.join(per_run, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("records", "failed")})
    folded = s.groupBy("projection", "status").agg(
        F.count("*").alias("n"), F.sum("records").alias("records"), F.sum("failed").alias("failed"), F.count_if(F.col("records") == 0).alias("conflicts"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    none, never = F.lit(None).cast("string"), F.lit(None).cast("timestamp")

    def rows(df: DataFrame, name: str, value, dimension=none, at=never, projection="projection") -> DataFrame:
        return df.select(F.lit(name).alias("metric_name"), F.col(projection) if isinstance(projection, str) else projection.alias("projection"), dimension.alias("dimension_value"), value.cast("long").alias("metric_value"), at.alias("metric_timestamp"))

    whole = folded.groupBy("projection").agg(F.sum("n").alias("n"), F.sum("records").alias("records"), F.sum("failed").alias("failed"))
    by_line = s.select("projection", F.explode("by_status").alias("status", "n")).groupBy("projection", "status").agg(F.sum("n").alias("n"))
    late = folded.filter("status <> 'validated'").groupBy("projection").agg(F.min("first").alias("at"))
    parts = [
        rows(whole, "run_count", F.col("n")),
        rows(by_line, "run_status_count", F.col("n"), F.col("status")),
        rows(folded, "snapshot_status_count", F.col("n"), F.col("status")),
        rows(whole, "snapshot_record_count", F.col("records")),
        rows(runs.groupBy("projection").agg(F.countDistinct("subject").alias("n")), "snapshot_subject_count", F.col("n")),
        rows(whole, "snapshot_source_event_count", F.col("records") - F.col("failed")),
        rows(whole.filter("failed > 0"), "failure_code_count", F.col("failed"), F.lit("RETURNED")),
        rows(folded.groupBy("status").agg(F.sum("conflicts").alias("n")).filter("n > 0"), "conflict_count", F.col("n"), F.col("status"), projection=F.lit("all")),
        rows(late, "oldest_unvalidated_snapshot_age_seconds", F.floor(F.unix_seconds(now()) - F.unix_seconds("at")), at=F.col("at")),
        rows(folded.filter("status = 'validated'"), "latest_validated_snapshot_time", F.lit(None), at=F.col("last")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_ADAPTED = "metric_name, adapter_version, target_contract_version, dimension_value, metric_value, metric_timestamp"
_BY = "adapter_version, target_contract_version"


def adapter_runs(d: Domain) -> tuple[DataFrame, DataFrame]:
    """(runs, observations) of an adapter: runs are orders, each with a logical identity; observations are lines: repeats counted, conflicts, outputs by class and failures by code."""
    at = stamp("o_orderdate")
    runs = d.table("orders").select(
        F.col("o_orderkey").alias("run"), F.substring("o_orderpriority", 1, 1).alias("adapter_version"), F.when(F.col("o_custkey") % 3 == 0, "v2").otherwise("v1").alias("target_contract_version"),
        F.when(F.col("o_orderstatus") == "F", "failure").otherwise("mapped").alias("evidence_kind"), at.alias("created_at"), F.when(F.col("o_orderstatus") != "P", at + F.expr("interval 90 seconds")).alias("completed_at"),
    )
    flag = F.col("l_returnflag")
    seen = d.table("lineitem").select(
        F.col("l_orderkey").alias("run"), F.when(flag == "N", F.col("l_linenumber") - 1).otherwise(0).alias("duplicates"), (flag == "R").alias("conflict"),
        F.when(flag == "A", "EXACT").when(flag == "N", "LOSSY").alias("compatibility_class"), F.when((flag == "R") & (F.col("l_linestatus") == "F"), F.concat(F.lit("E"), (F.col("l_linenumber") % 3).cast("string"))).alias("failure_code"),
    )
    return runs, seen


def adapter_measures(runs: DataFrame, observations: DataFrame) -> DataFrame:
    """Eight metrics per (adapter_version, target_contract_version) and counts per class and per failure code, as rows. A run without observations counts with zeros.

    Observations are folded to their run before they meet it, runs once to their versions; the rows are made of that one fold."""
    by_class = observations.filter("compatibility_class is not null or failure_code is not null").groupBy("run", "compatibility_class", "failure_code").agg(F.count("*").alias("n"))
    entry = F.struct("compatibility_class", "failure_code", "n")
    per = observations.groupBy("run").agg(F.sum("duplicates").alias("duplicates"), F.count_if("conflict").alias("conflicts")).join(by_class.groupBy("run").agg(F.collect_list(entry).alias("seen")), "run", "left")
    met = runs.join(per, "run", "left")
    keys = ["adapter_version", "target_contract_version"]
    folded = met.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("evidence_kind") == "mapped").alias("mapped"), F.count_if(F.col("evidence_kind") == "failure").alias("failed"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicts"), F.min("created_at").alias("first"), F.max("completed_at").alias("last"),
    )
    none, never = F.lit(None).cast("long"), F.lit(None).cast("timestamp")
    age = F.floor(F.unix_micros(now()) / 1_000_000 - F.unix_micros("first") / 1_000_000)
    base = [
        ("run_count", F.col("n"), never), ("success_count", F.col("mapped"), never), ("failure_count", F.col("failed"), never), ("new_count", F.col("n"), never), ("duplicate_count", F.col("duplicates"), never), ("conflict_count", F.col("conflicts"), never),
        ("oldest_run_age_seconds", age, F.col("first")), ("latest_processed_at", none, F.col("last")),
    ]
    rows = folded.select(*keys, F.inline(F.array(*(F.struct(F.lit(name).alias("metric_name"), F.lit(None).cast("string").alias("dimension_value"), value.cast("long").alias("metric_value"), at.alias("metric_timestamp")) for name, value, at in base))))
    rows = rows.filter("metric_value > 0 or metric_name not in ('success_count', 'failure_count') or metric_value is null")
    each = met.select(*keys, F.inline("seen"))
    for name, value in (("compatibility_class_count", "compatibility_class"), ("failure_code_count", "failure_code")):
        counted = each.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("dimension_value")).agg(F.sum("n").alias("metric_value"))
        rows = rows.unionByName(counted.select(*keys, F.lit(name).alias("metric_name"), "dimension_value", "metric_value", never.alias("metric_timestamp")))
    return rows


@query(
    "adapter_metrics",
    f"""WITH r AS (SELECT o_orderkey AS run, substr(o_orderpriority, 1, 1) AS adapter_version, CASE WHEN o_custkey % 3 = 0 THEN 'v2' ELSE 'v1' END AS target_contract_version, CASE WHEN o_orderstatus = 'F' THEN 'failure' ELSE 'mapped' END AS kind,
        o_orderdate AS created, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 90 SECOND END AS completed FROM orders),
    s AS (SELECT l_orderkey AS run, CASE WHEN l_returnflag = 'N' THEN l_linenumber - 1 ELSE 0 END AS duplicates, l_returnflag = 'R' AS conflict, CASE l_returnflag WHEN 'A' THEN 'EXACT' WHEN 'N' THEN 'LOSSY' END AS class,
        CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'E' || (l_linenumber % 3) END AS code FROM lineitem),
    m(metric_name, {_BY}, dimension_value, metric_value, metric_timestamp) AS (SELECT 'run_count', {_BY}, NULL, count(*), NULL::TIMESTAMP FROM r GROUP BY ALL
    UNION ALL SELECT 'success_count', {_BY}, NULL, count(*), NULL FROM r WHERE kind = 'mapped' GROUP BY ALL
    UNION ALL SELECT 'failure_count', {_BY}, NULL, count(*), NULL FROM r WHERE kind = 'failure' GROUP BY ALL
    UNION ALL SELECT 'new_count', {_BY}, NULL, count(*), NULL FROM r GROUP BY ALL
    UNION ALL SELECT 'duplicate_count', {_BY}, NULL, coalesce(sum(duplicates), 0)::BIGINT, NULL FROM r LEFT JOIN s USING (run) GROUP BY ALL
    UNION ALL SELECT 'conflict_count', {_BY}, NULL, count(*) FILTER (WHERE conflict), NULL FROM r LEFT JOIN s USING (run) GROUP BY ALL
    UNION ALL SELECT 'oldest_run_age_seconds', {_BY}, NULL, floor(epoch(TIMESTAMP '{NOW}') - epoch(min(created)))::BIGINT, min(created) FROM r GROUP BY ALL
    UNION ALL SELECT 'latest_processed_at', {_BY}, NULL, NULL, max(completed) FROM r GROUP BY ALL
    UNION ALL SELECT 'compatibility_class_count', {_BY}, class, count(*), NULL FROM r JOIN s USING (run) WHERE class IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'failure_code_count', {_BY}, code, count(*), NULL FROM r JOIN s USING (run) WHERE code IS NOT NULL GROUP BY ALL)
    SELECT {_ADAPTED} FROM m""",
)
def adapter_metrics(d: Domain) -> DataFrame:
    return adapter_measures(*adapter_runs(d)).select(*_ADAPTED.split(", "))


@query(
    "check_verdict_counts",
    """WITH c AS (SELECT l_orderkey AS run, CASE WHEN l_returnflag = 'R' THEN 'FAIL' WHEN l_returnflag = 'A' THEN 'SKIPPED' ELSE 'PASS' END AS status,
        CASE l_linenumber % 3 WHEN 0 THEN 'BLOCKER' WHEN 1 THEN 'ERROR' ELSE 'WARNING' END AS severity, l_linestatus = 'F' AS required FROM lineitem)
    SELECT run, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'BLOCKER') AS blockers, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'ERROR') AS errors,
    count(*) FILTER (WHERE severity = 'WARNING') AS warnings, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed,
    count(*) FILTER (WHERE status = 'SKIPPED' AND required) AS skipped_required FROM c GROUP BY run""",
)
def check_verdict_counts(d: Domain) -> DataFrame:
    """Counts over the JSON array of checks that each run carries; the array is read in its row, without a shuffle."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber") % 3
    check = F.struct(
        F.when(flag == "R", "FAIL").when(flag == "A", "SKIPPED").otherwise("PASS").alias("checkStatus"),
        F.when(line == 0, "BLOCKER").when(line == 1, "ERROR").otherwise("WARNING").alias("severity"),
        (F.col("l_linestatus") == "F").alias("required"),
    )
    stored = d.table("lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.to_json(F.collect_list(check)).alias("checks"))
    parsed = stored.select("run", F.from_json("checks", "array<struct<checkStatus:string,severity:string,required:boolean>>").alias("c"))
    having = {
        "blockers": "x.checkStatus = 'FAIL' and x.severity = 'BLOCKER'", "errors": "x.checkStatus = 'FAIL' and x.severity = 'ERROR'", "warnings": "x.severity = 'WARNING'",
        "passed": "x.checkStatus = 'PASS'", "failed": "x.checkStatus = 'FAIL'", "skipped_required": "x.checkStatus = 'SKIPPED' and coalesce(x.required, false)",
    }
    return parsed.select("run", *(F.expr(f"cast(size(filter(c, x -> {v})) as bigint)").alias(k) for k, v in having.items()))


#: The keys that a fingerprint's canonical input has, no more and no fewer.
FINGERPRINT_KEYS = ("actorRef", "canonicalizationVersion", "causationId", "contractVersion", "entityRef", "eventFamily", "eventType", "occurredAt", "payload", "schemaVersion", "sessionRef")


@query(
    "fingerprint_key_set",
    f"""WITH j AS (SELECT event_id, list_concat({list(FINGERPRINT_KEYS[:10])}, CASE WHEN event_id % 7 = 0 THEN [] WHEN event_id % 7 = 1 THEN ['traceRef'] WHEN event_id % 7 = 2 THEN ['sessionRef', 'traceRef'] ELSE ['sessionRef'] END) AS keys FROM behaviour)
    SELECT event_id, len(keys)::INTEGER AS n_keys, len(list_filter(keys, lambda x: NOT list_contains({list(FINGERPRINT_KEYS)}, x)))::INTEGER AS n_unknown,
    len(keys) = 11 AND len(list_filter(keys, lambda x: NOT list_contains({list(FINGERPRINT_KEYS)}, x))) = 0 AS accepted FROM j""",
    ("behaviour",),
)
def fingerprint_key_set(d: Domain) -> DataFrame:
    """Whether a JSON object has exactly the approved keys."""
    first = ",".join(f'"{k}":"x"' for k in FINGERPRINT_KEYS[:10])
    case = F.col("event_id") % 7
    rest = F.when(case == 0, "").when(case == 1, ',"traceRef":1').when(case == 2, ',"sessionRef":1,"traceRef":1').otherwise(',"sessionRef":1')
    keys = d.behaviour.select("event_id", F.json_object_keys(F.concat(F.lit("{" + first), rest, F.lit("}"))).alias("keys"))
    unknown = F.size(F.array_except("keys", F.array(*map(F.lit, FINGERPRINT_KEYS))))
    return keys.select("event_id", F.size("keys").alias("n_keys"), unknown.alias("n_unknown"), ((F.size("keys") == 11) & (unknown == 0)).alias("accepted"))


#: Regions whose slug, alone or before "-", is a feature; and tags that are features.
REGION_FEATURES = ("seoul", "busan", "jeju", "gangwon", "gyeongju")
TAG_FEATURES = {
    "food": "theme:food", "cafe": "theme:cafe", "nature": "theme:nature", "history": "theme:history", "adventure": "theme:adventure", "wellness": "theme:wellness",
    "running": "activity:running", "plogging": "activity:plogging", "pilgrimage": "activity:pilgrimage", "cycling": "activity:cycling",
    "solo-travel": "companion:solo", "couple-trip": "companion:couple", "family-trip": "companion:family",
}
_SLUGS = ["kr-seoul", "kr-seoul-mapo", "kr-seoulish", "kr-busan", "kr-jeju-si", "kr-gangwon", "kr-gyeongju-x", "jp-tokyo", ""]
_TAGS = [*TAG_FEATURES, "hotel", "Food"]


def region_feature(slug):
    name = F.regexp_extract(slug, rf"^kr-({'|'.join(REGION_FEATURES)})(?:-.*)?$", 1)
    return F.when(name != "", F.concat(F.lit("region:"), name))


def tag_feature(tag):
    return F.create_map(*(F.lit(x) for kv in TAG_FEATURES.items() for x in kv))[tag]


@query(
    "feature_names",
    f"""WITH p AS (SELECT post_id, ({_SLUGS})[1 + post_id % {len(_SLUGS)}] AS slug, ({_TAGS})[1 + post_id % {len(_TAGS)}] AS tag FROM posts)
    SELECT post_id, CASE {' '.join(f"WHEN slug = 'kr-{r}' OR starts_with(slug, 'kr-{r}-') THEN 'region:{r}'" for r in REGION_FEATURES)} END AS region_feature,
    CASE tag {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in TAG_FEATURES.items())} END AS tag_feature FROM p""",
    ("posts",),
)
def feature_names(d: Domain) -> DataFrame:
    """Features named by region slugs and by tags; others have none."""

    def nth(values: list[str]):
        return F.element_at(F.array(*map(F.lit, values)), (1 + F.col("post_id") % len(values)).cast("int"))

    return d.posts.select("post_id", region_feature(nth(_SLUGS)).alias("region_feature"), tag_feature(nth(_TAGS)).alias("tag_feature"))


@query(
    "signal_count_maps",
    """WITH c AS (SELECT user_id, kind, count(*) AS n FROM behaviour GROUP BY 1, 2)
    SELECT user_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS counts, coalesce(string_agg(kind || '=' || n, ',' ORDER BY kind) FILTER (WHERE kind IN ('click', 'save', 'follow')), '') AS positive,
    coalesce(string_agg(kind || '=' || n, ',' ORDER BY kind) FILTER (WHERE kind = 'report'), '') AS negative FROM c GROUP BY user_id""",
    ("behaviour",),
)
def signal_count_maps(d: Domain) -> DataFrame:
    """Merged counts by kind as a map, and its parts that are positive and negative signals. A map has as many entries as there are kinds."""
    counts = d.behaviour.groupBy("user_id", "kind").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("m"))

    def text(m):
        return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")

    return maps.select(
        "user_id", text(F.col("m")).alias("counts"),
        text(F.map_filter("m", lambda k, _: k.isin("click", "save", "follow"))).alias("positive"), text(F.map_filter("m", lambda k, _: k == "report")).alias("negative"),
    )


@query(
    "exposure_sessions",
    """WITH x AS (SELECT event_id AS exposure_id, user_id, post_id % 10 AS entity, ts AS served_at FROM behaviour WHERE kind = 'view'),
    o AS (SELECT event_id, user_id, post_id % 10 AS entity, ts FROM behaviour WHERE kind IN ('click', 'save')),
    j AS (SELECT o.event_id, x.exposure_id, o.ts, x.served_at, row_number() OVER (PARTITION BY o.event_id ORDER BY x.served_at DESC, x.exposure_id DESC) AS n FROM o LEFT JOIN x ON x.user_id = o.user_id AND x.entity = o.entity AND x.served_at <= o.ts)
    SELECT event_id, exposure_id, CASE WHEN exposure_id IS NULL THEN 'EXPOSURE_BINDING_MISSING' WHEN ts >= served_at + INTERVAL 7 DAY THEN 'OUTCOME_WINDOW_VIOLATION' ELSE 'IN_WINDOW' END AS verdict FROM j WHERE n = 1""",
    ("behaviour",),
)
def exposure_sessions(d: Domain, days: int = 7) -> DataFrame:
    """Each outcome in the session that its latest exposure opened: [exposed, exposed + 7 days); outside is a failure."""
    bound = as_of(outcomes(d), exposures(d), ["user_id", "entity"], "ts", "served_at", "exposure_id")
    late = F.col("ts") >= F.col("served_at") + F.make_dt_interval(F.lit(days))
    verdict = F.when(F.col("exposure_id").isNull(), "EXPOSURE_BINDING_MISSING").when(late, "OUTCOME_WINDOW_VIOLATION").otherwise("IN_WINDOW")
    return bound.select("event_id", "exposure_id", verdict.alias("verdict"))


#: Executions of a piece of work at most, and equal failures in a row (this one included) that quarantine it.
MOST_ATTEMPTS, SAME_FAILURES = 6, 3


@query(
    "failed_work_outcomes",
    f"""WITH a AS (SELECT event_id, user_id, ts, event_id % 5 <> 0 AS retryable, post_id % 2 AS signature, row_number() OVER w AS attempt, lag(post_id % 2, 1) OVER w AS s1, lag(post_id % 2, 2) OVER w AS s2 FROM behaviour WHERE kind = 'report' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, attempt, CASE WHEN retryable AND attempt < {MOST_ATTEMPTS} AND NOT coalesce(signature = s1 AND signature = s2, FALSE) THEN 'retry_scheduled' WHEN retryable AND attempt >= {MOST_ATTEMPTS} THEN 'retry_exhausted' ELSE 'quarantined' END AS outcome,
    CASE WHEN retryable AND attempt < {MOST_ATTEMPTS} AND NOT coalesce(signature = s1 AND signature = s2, FALSE) THEN NULL WHEN retryable AND attempt >= {MOST_ATTEMPTS} THEN 'retry_exhausted' WHEN retryable THEN 'repeated_deterministic_failure' ELSE 'unclassified_failure' END AS reason FROM a""",
    ("behaviour",),
)
def failed_work_outcomes(d: Domain) -> DataFrame:
    """What a failed attempt leads to: another one, or the end for its number, its repeated signature or its class."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = d.behaviour.filter("kind = 'report'").select("event_id", "user_id", "ts", (F.col("event_id") % 5 != 0).alias("retryable"), (F.col("post_id") % 2).alias("signature"))
    a = a.withColumns({"attempt": F.row_number().over(w), **{f"s{k}": F.lag("signature", k).over(w) for k in range(1, SAME_FAILURES)}})
    same = F.coalesce((F.col("signature") == F.col("s1")) & (F.col("signature") == F.col("s2")), F.lit(False))
    again = F.col("retryable") & (F.col("attempt") < MOST_ATTEMPTS) & ~same
    spent = F.col("retryable") & (F.col("attempt") >= MOST_ATTEMPTS)
    return a.select(
        "event_id", "attempt", F.when(again, "retry_scheduled").when(spent, "retry_exhausted").otherwise("quarantined").alias("outcome"),
        F.when(~again, F.when(spent, "retry_exhausted").when(F.col("retryable"), "repeated_deterministic_failure").otherwise("unclassified_failure")).alias("reason"),
    )
