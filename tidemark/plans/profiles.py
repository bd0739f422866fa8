"""Profile inputs projected from behaviour sources: a batch fails as a whole with its first failure, or gives a record per subject and window, with lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fingerprint import fold, row_hash, row_text, sql_fold, sql_text
from ..operators.keyed import join_counted
from ..sources.sinks import stage
from ..sources.tables import NOW, Domain
from .events import _prefixed, fingerprint
from .registry import query

# The schema, windows in days, references per list, signals.
SCHEMA, DAYS, LISTED = "recommendation-profile-input-v1", (7, 30, 90), 20
POSITIVE = ("recommendation_click", "post_like", "post_bookmark", "post_share", "follow", "tag_click", "crew_join")
NEGATIVE = ("post_unlike", "post_unbookmark", "post_hide", "post_report", "unfollow", "crew_leave")
# Failures of a batch before its sources are read, of a source, and after them; (code, field, detail, condition), in order.
BEFORE = (
    ("UNSUPPORTED_PROJECTION_SCHEMA", "definition", "profile_schema", f"schema is null or schema <> '{SCHEMA}'"),
    ("SOURCE_CHECKPOINT_INVALID", "checkpoint", "source_set", "not (found_print <=> checkpoint_print)"),
    ("PROJECTION_INVARIANT_FAILED", "source", "duplicate_conflict", "conflicts > 0"),
    ("IDENTITY_NAMESPACE_CONFLICT", "identity", "binding_conflict", "clashes > 0"),
)
PER_SOURCE = (
    ("UNSUPPORTED_SOURCE_SCHEMA", "source", "schema_version", "not (contract <=> source_contract)"),
    ("SOURCE_FINGERPRINT_MISMATCH", "source", "fingerprint", "not (sha2(form, 256) <=> print)"),
    ("SOURCE_CHECKPOINT_INVALID", "occurredAt", "future_event", "occurred_at >= as_of"),
    ("ADAPTER_EVIDENCE_CONFLICTED", "adapter", "conflicted", "state = 'CONFLICTED'"),
    ("ADAPTER_EVIDENCE_REJECTED", "adapter", "rejected", "state = 'REJECTED'"),
    ("UNSUPPORTED_SOURCE_SCHEMA", "adapter", "unsupported", "state = 'UNSUPPORTED'"),
    ("IDENTITY_BINDING_REQUIRED", "identity", "binding_required", "subject is null"),
)
AFTER = (("SOURCE_EVENT_MISSING", "source", "no_included_event"), ("LINEAGE_INCOMPLETE", "lineage", "no_window_lineage"))
# End of the fixed values.
FAILURES = (*BEFORE, *PER_SOURCE, *AFTER)
KEY = ["batch", "ref", "print"]
RECORD = ["batch", "subject", "days"]


def _first(checks: tuple, at: int) -> Column:
    return F.coalesce(*(F.when(F.expr(c), at + i) for i, (*_, c) in enumerate(checks)))


def _listed(rows: DataFrame, name: str, text: Column, by: Column) -> DataFrame:
    """RECORD and the texts in their order, joined; a record has few rows here."""
    both = F.array_sort(F.collect_list(F.struct(by.alias("by"), text.alias("text"))))
    return rows.groupBy(*RECORD).agg(F.array_join(F.transform(both, lambda x: x["text"]), ",").alias(name))


def _ranked(rows: DataFrame, reference: str, name: str) -> DataFrame:
    """The LISTED references of each record by count, then last time, then name. Ranked in every task before they are shuffled, so a record of very many
    references sends few."""
    each = rows.filter(F.col(reference).isNotNull()).groupBy(*RECORD, F.col(reference).alias("r")).agg(F.count("*").alias("n"), F.max("occurred_at").alias("last"))
    w = Window.partitionBy(*RECORD).orderBy(F.desc("n"), F.desc("last"), "r")
    best = each.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= LISTED)
    return _listed(best, name, F.concat("r", F.lit("*"), F.col("n").cast("string")), F.col("place"))


def project_profiles(definitions: DataFrame, sources: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(batches, records, lineage).

    definitions: a row per batch with schema, source_contract, version, as_of, checkpoint_print (of the set of (ref, print), in no order).
    sources: batch, ref, print, form, contract, state, evidence, type, identity, occurred_at, region, content, tags; in any number of deliveries.
    identities: batch, identity, subject, version, repeated or not.

    batches: every definition with code, field and detail of its first failure, nulls where there is none; among sources the first is the one that
    occurred first, then by ref and print. records: per subject and window of a batch without failure, its counts, ranked references and prints.
    lineage: batch, subject, days, ref, print, evidence. Sources of a batch without definition are left out. An identity that is a subject
    stands for itself; one bound under another version is unbound.
    Deliveries are folded first; large batches meet their definition by a broadcast of counted keys. A source is at most one row per window."""
    sources = stage(sources, "profile_sources")
    rest = [c for c in sources.columns if c not in KEY]
    delivered = row_hash(row_text(*(c for c in sources.columns if c not in ("occurred_at", "tags")), "at", "tag_text"))
    hashed = sources.withColumns({"at": F.unix_micros("occurred_at"), "tag_text": F.array_join("tags", ",", "~")}).withColumn("_h", delivered)
    once = hashed.groupBy(*KEY).agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"), F.min_by(F.struct(*rest), "_h").alias("row"))
    once = stage(once.select(*KEY, "row.*", (F.col("lo") != F.col("hi")).alias("conflict")), "profile_once")
    n = once.groupBy("batch").agg(F.count("*").alias("n"), F.count_if("conflict").alias("conflicts"), fold(row_hash(row_text("ref", "print"))).alias("found_print"))
    bound = identities.groupBy("batch", "identity").agg(F.min(F.struct("subject", "version")).alias("lo"), F.max(F.struct("subject", "version")).alias("hi"))
    bound = stage(bound.select("batch", "identity", F.col("lo.subject").alias("bound"), F.col("lo.version").alias("bound_version"), (F.col("lo") != F.col("hi")).alias("clash")), "profile_identities")
    clashes = bound.groupBy("batch").agg(F.count_if("clash").alias("clashes"))
    empty = fold(row_hash(F.lit(None).cast("string")))
    nothing = once.filter("false").agg(empty.alias("p")).first()["p"]
    judged = definitions.join(n, "batch", "left").join(clashes, "batch", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "conflicts", "clashes")})
    judged = judged.withColumn("found_print", F.coalesce("found_print", F.lit(nothing)))
    judged = stage(judged.withColumn("before", _first(BEFORE, 0)), "profile_judged")
    ready = judged.filter("before is null").select("batch", "n", "source_contract", "version", "as_of")
    total = ready.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    seen = join_counted(once.drop("conflict"), ready, ["batch"], "n", total).join(bound.drop("clash"), ["batch", "identity"], "left")
    subject = F.when(F.col("identity").startswith("subject:"), F.col("identity")).when(F.col("bound_version") == F.col("version"), F.col("bound"))
    windows = F.filter(F.array(*map(F.lit, DAYS)), lambda d: F.col("occurred_at") >= F.col("as_of") - F.make_dt_interval(d))
    seen = seen.withColumn("subject", subject).withColumns({"failed": _first(PER_SOURCE, len(BEFORE)), "windows": windows})
    seen = stage(seen.drop("bound", "bound_version", "source_contract", "version", "form", "contract", "state"), "profile_seen")
    per = seen.groupBy("batch").agg(
        F.min(F.when(F.col("failed").isNotNull(), F.struct("occurred_at", "ref", "print", "failed")))["failed"].alias("failed"), F.max(F.size("windows")).alias("widest")
    )
    number = F.coalesce("before", "failed", F.when(F.col("n") == 0, len(FAILURES) - 2), F.when(F.col("widest") == 0, len(FAILURES) - 1))
    ended = stage(judged.join(per, "batch", "left").withColumn("number", number).select("batch", "n", "number"), "profile_ended")
    texts = [F.when(F.col("number").isNotNull(), F.element_at(F.array(*(F.lit(f[k]) for f in FAILURES)), F.col("number") + 1)).alias(name) for k, name in enumerate(("code", "field", "detail"))]
    batches = ended.select("batch", *texts)

    good = ended.filter("number is null").select("batch", "n")
    rows = join_counted(seen.drop("n", "failed"), good, ["batch"], "n", total).withColumn("days", F.explode("windows"))
    rows = stage(rows.drop("windows", "n", "identity", "as_of"), "profile_rows")
    lineage = rows.select(*RECORD, "ref", "print", "evidence")
    whole = rows.groupBy(*RECORD).agg(
        F.count("*").alias("n_sources"), F.count_if(F.col("type").isin(*POSITIVE)).alias("n_positive"), F.count_if(F.col("type").isin(*NEGATIVE)).alias("n_negative"),
        fold(row_hash(row_text("ref", "print", "evidence"))).alias("lineage_print"),
    )
    types = rows.groupBy(*RECORD, "type").agg(F.count("*").alias("n"))
    shown = F.concat("type", F.lit("="), F.col("n").cast("string"))
    records = whole.join(_listed(types, "interactions", shown, F.col("type")), RECORD, "left")
    for name, signals in (("positive", POSITIVE), ("negative", NEGATIVE)):
        records = records.join(_listed(types.filter(F.col("type").isin(*signals)), name, shown, F.col("type")), RECORD, "left")
    tagged = rows.select(*RECORD, "occurred_at", F.explode("tags").alias("tag"))
    for name, table, reference in (("regions", rows, "region"), ("contents", rows, "content"), ("tags", tagged, "tag")):
        records = records.join(_ranked(table, reference, name), RECORD, "left")
    texts = ("interactions", "positive", "negative", "regions", "contents", "tags")
    records = records.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})
    return batches, records.withColumn("record_print", fingerprint(*RECORD, "n_sources", *texts, "lineage_print")), lineage


#: Stand-ins: behaviour of two members is a batch. Defects are planted at multiples of primes; expressions are read by both engines.
_TYPE = """CASE WHEN kind = 'click' THEN 'recommendation_click' WHEN kind = 'save' AND event_id % 2 = 0 THEN 'post_like' WHEN kind = 'save' THEN 'post_bookmark' WHEN kind = 'follow' AND event_id % 4 = 0 THEN 'unfollow'
    WHEN kind = 'follow' THEN 'follow' WHEN kind = 'report' AND event_id % 4 = 0 THEN 'post_hide' WHEN kind = 'report' THEN 'post_report' WHEN event_id % 5 = 0 THEN 'post_unlike' ELSE 'post_view' END"""
_FIELDS = {
    "batch": "CAST(floor(user_id / 2) AS BIGINT)", "type": _TYPE, "ref": "concat('e', event_id)", "contract": "CASE WHEN event_id % 2017 = 0 THEN 'p0-v0' ELSE 'p0-v1' END",
    "state": "CASE WHEN event_id % 2027 = 0 THEN 'CONFLICTED' WHEN event_id % 2029 = 0 THEN 'REJECTED' WHEN event_id % 2039 = 0 THEN 'UNSUPPORTED' ELSE 'MAPPED' END",
    "identity": "CASE WHEN event_id % 2003 = 0 THEN 'user:none' WHEN event_id % 3 = 0 THEN concat('subject:', user_id) ELSE concat('user:', user_id) END",
    "region": "CASE WHEN event_id % 6 <> 0 THEN concat('region:', post_id % 25) END", "content": "CASE WHEN event_id % 10 <> 0 THEN concat('post:', post_id) END",
}
_FORM = "concat(ref, '|', type)"
_DEFINED = {
    "schema": f"CASE WHEN batch % 37 = 36 THEN 'recommendation-profile-input-v0' ELSE '{SCHEMA}' END", "source_contract": "'p0-v1'", "version": "'b1'",
    "as_of": f"CASE WHEN batch % 29 = 28 THEN TIMESTAMP '{NOW}' - INTERVAL 25 DAY WHEN batch % 31 = 3 THEN TIMESTAMP '{NOW}' + INTERVAL 300 DAY ELSE TIMESTAMP '{NOW}' END",
}
_VERSION = "CASE WHEN user_id % 41 = 40 THEN 'b0' ELSE 'b1' END"


def profile_inputs(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = d.behaviour
    for name, of in _FIELDS.items():
        b = b.withColumn(name, F.expr(of))
    n = F.col("event_id")
    tags = F.when(n % 2 == 0, F.array(F.expr("concat('tag:', post_id % 7)"), F.expr("concat('tag:', 10 + post_id % 3)"))).otherwise(F.array(F.expr("concat('tag:', post_id % 7)")))
    times = F.when((n % 50 == 0) | (n % 2053 == 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    b = b.withColumns({"form": F.expr(_FORM), "tags": tags, "delivery": F.explode(times)})
    evidence = F.concat(F.lit("a"), n.cast("string"), F.when((n % 2053 == 0) & (F.col("delivery") == 1), "!").otherwise(""))
    sources = b.select("batch", "ref", F.when(n % 2011 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("form", 256)).alias("print"), "form", "contract", "state", evidence.alias("evidence"), "type", "identity", F.col("ts").alias("occurred_at"), "region", "content", "tags")
    # what each checkpoint holds: the sources, but for a few that came later
    held = b.filter("delivery = 0 and event_id % 2063 <> 0").select("batch", "ref", F.when(n % 2011 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("form", 256)).alias("print"))
    definitions = held.groupBy("batch").agg(fold(row_hash(row_text("ref", "print"))).alias("checkpoint_print"))
    definitions = definitions.withColumns({k: F.expr(v) for k, v in _DEFINED.items()})
    users = d.behaviour.select("user_id").distinct().withColumns({"batch": F.expr(_FIELDS["batch"]), "version": F.expr(_VERSION)})
    own = F.concat(F.lit("subject:"), F.col("user_id").cast("string"))
    subjects = F.when(F.col("user_id") % 43 == 42, F.array(own, F.concat(own, F.lit("x")))).otherwise(F.array(own))
    identities = users.select("batch", F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("identity"), F.explode(subjects).alias("subject"), "version")
    return definitions, sources, identities


def _case(checks: tuple, at: int) -> str:
    fixed = [c.replace("not (", "NOT (").replace("sha2(form, 256)", "sha256(form)").replace("<=>", "IS NOT DISTINCT FROM") for *_, c in checks]
    return "CASE " + " ".join(f"WHEN {c} THEN {at + i}" for i, c in enumerate(fixed)) + " END"


def _chosen(k: int) -> str:
    return "CASE number " + " ".join(f"WHEN {i} THEN '{f[k]}'" for i, f in enumerate(FAILURES)) + " END"


_STEPS = f"""WITH b AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _FIELDS.items())} FROM behaviour), f AS (SELECT *, {_FORM} AS form FROM b),
    once AS (SELECT *, CASE WHEN event_id % 2011 = 0 THEN sha256('x') ELSE sha256(form) END AS print, 'a' || event_id AS evidence, ts AS occurred_at, event_id % 2053 = 0 AS conflict,
        CASE WHEN event_id % 2 = 0 THEN ['tag:' || (post_id % 7), 'tag:' || (10 + post_id % 3)] ELSE ['tag:' || (post_id % 7)] END AS tags FROM f),
    n AS (SELECT batch, count(*) AS n, count(*) FILTER (WHERE conflict) AS conflicts, {sql_fold(sql_text('ref', 'print'))} AS found_print FROM once GROUP BY batch),
    c AS (SELECT batch, {sql_fold(sql_text('ref', 'print'))} AS checkpoint_print FROM once WHERE event_id % 2063 <> 0 GROUP BY batch),
    u AS (SELECT DISTINCT user_id, {_FIELDS['batch']} AS batch FROM behaviour), i AS (SELECT batch, count(*) FILTER (WHERE user_id % 43 = 42) AS clashes FROM u GROUP BY batch),
    d AS (SELECT batch, checkpoint_print, {', '.join(f'{v} AS {k}' for k, v in _DEFINED.items())} FROM c),
    j AS (SELECT d.*, n.n, conflicts, found_print, clashes FROM d JOIN n USING (batch) JOIN i USING (batch)), jb AS (SELECT *, {_case(BEFORE, 0)} AS before FROM j),
    s AS (SELECT o.*, as_of, source_contract, CASE WHEN identity LIKE 'subject:%' THEN identity WHEN identity = 'user:' || user_id AND {_VERSION} = 'b1' THEN 'subject:' || user_id END AS subject FROM once o JOIN jb USING (batch) WHERE before IS NULL),
    v AS (SELECT *, {_case(PER_SOURCE, len(BEFORE))} AS failed FROM s),
    p AS (SELECT batch, arg_min(failed, (occurred_at, ref, print)) FILTER (WHERE failed IS NOT NULL) AS failed, bool_or(occurred_at >= as_of - INTERVAL {max(DAYS)} DAY) AS any_in FROM v GROUP BY batch),
    e AS (SELECT batch, coalesce(before, failed, CASE WHEN NOT any_in THEN {len(FAILURES) - 1} END) AS number FROM jb LEFT JOIN p USING (batch)),
    r AS (SELECT v.*, days FROM v JOIN e USING (batch) JOIN (SELECT unnest({list(DAYS)}) AS days) ON occurred_at >= as_of - to_days(days::INTEGER) WHERE number IS NULL)"""
_BY = "batch, subject, days"


def _sql_types(name: str, only: str = "true") -> str:
    return f"{name} AS (SELECT {_BY}, string_agg(type || '=' || n, ',' ORDER BY type) AS {name} FROM (SELECT {_BY}, type, count(*) AS n FROM r WHERE {only} GROUP BY ALL) GROUP BY ALL)"


def _sql_ranked(name: str, reference: str, table: str = "r") -> str:
    return f"""{name} AS (SELECT {_BY}, string_agg(q || '*' || n, ',' ORDER BY place) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY {_BY} ORDER BY n DESC, latest DESC, q) AS place FROM
        (SELECT {_BY}, {reference} AS q, count(*) AS n, max(occurred_at) AS latest FROM {table} WHERE {reference} IS NOT NULL GROUP BY {_BY}, {reference})) WHERE place <= {LISTED} GROUP BY {_BY})"""


_LISTS = ("interactions", "positive", "negative", "regions", "contents", "tags")
_RECORDS = f"""{_STEPS}, w AS (SELECT {_BY}, count(*) AS n_sources, count(*) FILTER (WHERE type IN {POSITIVE}) AS n_positive, count(*) FILTER (WHERE type IN {NEGATIVE}) AS n_negative, {sql_fold(sql_text('ref', 'print', 'evidence'))} AS lineage_print FROM r GROUP BY {_BY}),
    t AS (SELECT {_BY}, occurred_at, unnest(tags) AS tag FROM r),
    {_sql_types('interactions')}, {_sql_types('positive', f'type IN {POSITIVE}')}, {_sql_types('negative', f'type IN {NEGATIVE}')}, {_sql_ranked('regions', 'region')}, {_sql_ranked('contents', 'content')}, {_sql_ranked('tags', 'tag', 't')},
    a AS (SELECT {_BY}, n_sources, n_positive, n_negative, lineage_print, {', '.join(f"coalesce({c}.{c}, '') AS {c}" for c in _LISTS)} FROM w {' '.join(f'LEFT JOIN {c} USING ({_BY})' for c in _LISTS)})
    SELECT *, {_prefixed(*RECORD, 'n_sources', *_LISTS, 'lineage_print')} AS record_print FROM a"""


@query("profile_batches", f"{_STEPS} SELECT batch, {_chosen(0)} AS code, {_chosen(1)} AS field, {_chosen(2)} AS detail FROM e", ("behaviour",))
def profile_batches(d: Domain) -> DataFrame:
    """Every batch with its first failure."""
    return project_profiles(*profile_inputs(d))[0]


@query("profile_records", _RECORDS, ("behaviour",))
def profile_records(d: Domain) -> DataFrame:
    """Records of the batches that passed."""
    return project_profiles(*profile_inputs(d))[1]


@query("profile_lineage", f"{_STEPS} SELECT {_BY}, ref, print, evidence FROM r", ("behaviour",))
def profile_lineage(d: Domain) -> DataFrame:
    """What each record was made of."""
    return project_profiles(*profile_inputs(d))[2]
