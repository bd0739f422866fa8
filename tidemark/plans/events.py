"""Behaviour events: idempotent intake, attribution, state, projection, quality, retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import as_of
from ..sources.tables import NOW, Domain, now
from .experiments import STEPS
from .registry import query

#: Labels of idempotent intake.
NEW, DUPLICATE, CONFLICT = "NEW", "DUPLICATE", "CONFLICT"


def fingerprint(*columns: str) -> Column:
    """SHA-256 over length-prefixed values, so that no two rows of values share a text."""
    parts = []
    for c in columns:
        s = F.coalesce(F.col(c).cast("string"), F.lit(""))
        parts += [F.octet_length(s).cast("string"), F.lit(":"), s, F.lit("|")]
    return F.sha2(F.concat(*parts), 256)


def _prefixed(*columns: str) -> str:
    return "sha256(" + " || ".join(f"octet_length(encode(coalesce({c}::VARCHAR, '')))::VARCHAR || ':' || coalesce({c}::VARCHAR, '') || '|'" for c in columns) + ")"


@query(
    "idempotent_intake",
    f"""WITH e AS (SELECT event_id, ts, user_id::VARCHAR || ':' || post_id || ':' || kind AS key, {_prefixed('user_id', 'post_id', 'kind', 'floor(value / 100)::BIGINT')} AS print FROM behaviour),
    f AS (SELECT *, first_value(print) OVER (PARTITION BY key ORDER BY ts, event_id) AS first_print, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM e)
    SELECT event_id, key, CASE WHEN n = 1 THEN '{NEW}' WHEN print = first_print THEN '{DUPLICATE}' ELSE '{CONFLICT}' END AS outcome FROM f""",
    ("behaviour",),
)
def idempotent_intake(d: Domain) -> DataFrame:
    """The first event of a key is new; later ones repeat it or conflict with it."""
    rows = d.behaviour.withColumn("key", F.concat_ws(":", "user_id", "post_id", "kind")).withColumn("step", F.floor(F.col("value") / 100))
    return classify_intake(rows.withColumn("print", fingerprint("user_id", "post_id", "kind", "step"))).select("event_id", "key", "outcome")


def classify_intake(rows: DataFrame) -> DataFrame:
    """Adds outcome to rows with key, print, ts, event_id."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    ranked = rows.withColumns({"_first": F.first("print").over(w), "_n": F.row_number().over(w)})
    outcome = F.when(F.col("_n") == 1, NEW).when(F.col("print") == F.col("_first"), DUPLICATE).otherwise(CONFLICT)
    return ranked.withColumn("outcome", outcome).drop("_first", "_n")


@query(
    "idempotency_scope",
    "SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN 'actor:' || user_id ELSE 'session:' || (event_id % 97) END AS scope FROM behaviour",
    ("behaviour",),
)
def idempotency_scope(d: Domain) -> DataFrame:
    actor = F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("actor:"), F.col("user_id").cast("string")))
    return d.behaviour.select("event_id", F.coalesce(actor, F.concat(F.lit("session:"), (F.col("event_id") % 97).cast("string"))).alias("scope"))


_EXPOSURES = "SELECT event_id AS exposure_id, user_id, post_id % 10 AS entity, ts AS served_at FROM behaviour WHERE kind = 'view'"
_OUTCOMES = "SELECT event_id, user_id, post_id % 10 AS entity, kind, ts FROM behaviour WHERE kind IN ('click', 'save')"


def exposures(d: Domain) -> DataFrame:
    return d.behaviour.filter("kind = 'view'").select(F.col("event_id").alias("exposure_id"), "user_id", (F.col("post_id") % 10).alias("entity"), F.col("ts").alias("served_at"))


def outcomes(d: Domain) -> DataFrame:
    return d.behaviour.filter("kind in ('click', 'save')").select("event_id", "user_id", (F.col("post_id") % 10).alias("entity"), "kind", "ts")


@query(
    "asof_exposure",
    f"""WITH x AS ({_EXPOSURES}), o AS ({_OUTCOMES}),
    j AS (SELECT o.*, x.exposure_id, x.served_at, row_number() OVER (PARTITION BY o.event_id ORDER BY x.served_at DESC, x.exposure_id DESC) AS n
        FROM o LEFT JOIN x ON x.user_id = o.user_id AND x.entity = o.entity AND x.served_at <= o.ts)
    SELECT event_id, user_id, entity, kind, ts, exposure_id, served_at FROM j WHERE n = 1""",
    ("behaviour",),
)
def asof_exposure(d: Domain) -> DataFrame:
    """The latest exposure of the entity to the member at or before each outcome."""
    return as_of(outcomes(d), exposures(d), ["user_id", "entity"], "ts", "served_at", "exposure_id").select("event_id", "user_id", "entity", "kind", "ts", "exposure_id", "served_at")


@query(
    "asof_state_strict",
    """SELECT o_orderkey AS run_id, coalesce((SELECT arg_max(o_orderstatus, (p.o_orderdate, p.o_orderkey)) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate), 'empty') AS state FROM orders o""",
)
def asof_state_strict(d: Domain) -> DataFrame:
    """The member's state strictly before each run, or 'empty'."""
    o = d.table("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    p = d.table("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("was"), F.col("o_orderkey").alias("was_run"), F.col("o_orderstatus").alias("status"))
    return as_of(o, p, ["user_id"], "at", "was", "was_run", strict=True).select("run_id", F.coalesce("status", F.lit("empty")).alias("state"))


@query(
    "interval_attribution",
    f"""WITH x AS ({_EXPOSURES}), o AS ({_OUTCOMES})
    SELECT kind, count(*) AS pairs, count(DISTINCT o.event_id) AS outcomes FROM o JOIN x ON x.user_id = o.user_id AND x.entity = o.entity AND o.ts >= x.served_at
    AND o.ts <= x.served_at + CASE kind WHEN 'click' THEN INTERVAL 30 MINUTE ELSE INTERVAL 7 DAY END GROUP BY kind""",
    ("behaviour",),
)
def interval_attribution(d: Domain) -> DataFrame:
    """Outcomes within their kind's window after an exposure; both ends count.

    No pairs meet: in one sort per (member, entity), an outcome takes the exposures up to its time less those before its window."""
    o = outcomes(d).select("user_id", "entity", "event_id", "kind", "ts", F.when(F.col("kind") == "click", F.expr("interval 30 minutes")).otherwise(F.expr("interval 7 days")).alias("window"))
    marks = F.array(F.struct((F.col("ts") - F.col("window")).alias("t"), F.lit(0).alias("side")), F.struct(F.col("ts").alias("t"), F.lit(2).alias("side")))
    ends = o.select("user_id", "entity", "event_id", "kind", F.inline(marks))
    shown = exposures(d).select("user_id", "entity", F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("kind"), F.col("served_at").alias("t"), F.lit(1).alias("side"))
    w = Window.partitionBy("user_id", "entity").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    rows = ends.unionByName(shown).withColumn("so_far", F.count_if(F.col("side") == 1).over(w)).filter("event_id is not null")
    each = rows.groupBy("event_id", "kind").agg(F.sum(F.when(F.col("side") == 2, F.col("so_far")).otherwise(-F.col("so_far"))).alias("n"))
    return each.filter("n > 0").groupBy("kind").agg(F.sum("n").alias("pairs"), F.count("*").alias("outcomes"))


@query(
    "state_toggles",
    """WITH s AS (SELECT event_id, user_id, post_id, ts, value >= 50 AS turned FROM behaviour WHERE kind = 'click'),
    l AS (SELECT *, lag(turned, 1, false) OVER (PARTITION BY user_id, post_id ORDER BY ts, event_id) AS was FROM s)
    SELECT event_id, user_id, post_id, turned FROM l WHERE turned <> was""",
    ("behaviour",),
)
def state_toggles(d: Domain) -> DataFrame:
    """Events that change the state of (member, post), which is off at first."""
    w = Window.partitionBy("user_id", "post_id").orderBy("ts", "event_id")
    rows = d.behaviour.filter("kind = 'click'").withColumn("turned", F.col("value") >= 50)
    return rows.filter("turned is not null").withColumn("was", F.lag("turned", 1, False).over(w)).filter("turned <> was").select("event_id", "user_id", "post_id", "turned")


@query(
    "repeat_decay",
    """WITH r AS (SELECT user_id, post_id, kind, row_number() OVER (PARTITION BY user_id, post_id, kind ORDER BY ts, event_id) AS n FROM behaviour)
    SELECT user_id, round(sum(CASE WHEN kind NOT IN ('view', 'click') OR n = 1 THEN 1.0 WHEN n = 2 THEN 0.3 ELSE 0.1 END), 6) AS weight FROM r GROUP BY user_id""",
    ("behaviour",),
)
def repeat_decay(d: Domain) -> DataFrame:
    """Repeats of a view or click weigh 1, then 0.3, then 0.1."""
    n = F.row_number().over(Window.partitionBy("user_id", "post_id", "kind").orderBy("ts", "event_id"))
    rows = d.behaviour.withColumn("n", n)
    weight = F.when(~F.col("kind").isin("view", "click") | (F.col("n") == 1), 1.0).when(F.col("n") == 2, 0.3).otherwise(0.1)
    return rows.groupBy("user_id").agg(F.round(F.sum(weight), 6).alias("weight"))


@query(
    "ranked_references",
    """WITH c AS (SELECT user_id, post_id, count(*) AS n, max(ts) AS last FROM behaviour GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last DESC, post_id) AS rank FROM c)
    SELECT user_id, post_id, n, last, rank::INTEGER AS rank FROM r WHERE rank <= 20""",
    ("behaviour",),
)
def ranked_references(d: Domain, top: int = 20) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), F.desc("last"), "post_id")
    counts = d.behaviour.groupBy("user_id", "post_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


@query(
    "interval_union",
    """WITH i AS (SELECT user_id, event_id AS lo, event_id + 40 AS hi FROM behaviour),
    m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS parts FROM g GROUP BY user_id, island""",
    ("behaviour",),
)
def interval_union(d: Domain) -> DataFrame:
    """Closed intervals joined where they overlap or touch."""
    return merge_intervals(d.behaviour.select("user_id", F.col("event_id").alias("lo"), (F.col("event_id") + 40).alias("hi")), "user_id")


def merge_intervals(rows: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("parts")).drop("island")


@query(
    "rolling_windows",
    f"""SELECT user_id, days::INTEGER AS days, count(*) AS events, count(DISTINCT post_id) AS posts FROM behaviour, (SELECT unnest([7, 30, 90]) AS days)
    WHERE ts >= TIMESTAMP '{NOW}' - to_days(days::INTEGER) AND ts < TIMESTAMP '{NOW}' GROUP BY 1, 2""",
    ("behaviour",),
)
def rolling_windows(d: Domain) -> DataFrame:
    """Activity in [now - days, now) for three lengths; each event goes to the windows that hold it."""
    age = F.unix_micros(now()) - F.unix_micros("ts")
    inside = F.filter(F.array(F.lit(7), F.lit(30), F.lit(90)), lambda n: (age > 0) & (age <= n * F.lit(86_400_000_000)))
    rows = d.behaviour.select("user_id", "post_id", F.explode(inside).alias("days"))
    return rows.groupBy("user_id", "days").agg(F.count("*").alias("events"), F.countDistinct("post_id").alias("posts"))


@query(
    "failure_streaks",
    """WITH r AS (SELECT event_id, user_id, ts, floor(value / 20)::BIGINT % 3 AS sign FROM behaviour WHERE kind = 'report'),
    l AS (SELECT *, lag(sign, 1) OVER w AS a, lag(sign, 2) OVER w AS b FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, user_id, sign FROM l WHERE sign = a AND sign = b""",
    ("behaviour",),
)
def failure_streaks(d: Domain) -> DataFrame:
    """The third failure in a row with the same signature."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = d.behaviour.filter("kind = 'report'").withColumn("sign", F.floor(F.col("value") / 20) % 3)
    rows = rows.withColumns({"a": F.lag("sign", 1).over(w), "b": F.lag("sign", 2).over(w)})
    return rows.filter("sign = a and sign = b").select("event_id", "user_id", "sign")


@query(
    "late_arrivals",
    f"""WITH e AS (SELECT event_id, ts, ts + to_minutes((event_id % 50)::INTEGER * 60) AS arrived FROM behaviour)
    SELECT event_id, CASE WHEN arrived <= TIMESTAMP '2024-01-20 00:00:00' THEN 'ON_TIME' WHEN arrived <= TIMESTAMP '2024-01-21 00:00:00' THEN 'WITHIN_TOLERANCE' ELSE 'REBUILD_REQUIRED' END AS verdict
    FROM e WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'""",
    ("behaviour",),
)
def late_arrivals(d: Domain) -> DataFrame:
    """Events of a checkpoint's half-open time range by when they arrived."""
    arrived = F.col("ts") + F.make_dt_interval(F.lit(0), F.col("event_id") % 50)
    bound, tolerance = F.lit("2024-01-20 00:00:00").cast("timestamp"), F.lit("2024-01-21 00:00:00").cast("timestamp")
    rows = d.behaviour.withColumn("arrived", arrived).filter((F.col("ts") >= F.lit("2024-01-05 00:00:00").cast("timestamp")) & (F.col("ts") < bound))
    return rows.select("event_id", F.when(F.col("arrived") <= bound, "ON_TIME").when(F.col("arrived") <= tolerance, "WITHIN_TOLERANCE").otherwise("REBUILD_REQUIRED").alias("verdict"))


#: Minutes until each further attempt.
BACKOFF = (1, 5, 30, 120, 720)


@query(
    "retry_schedule",
    """WITH w AS (SELECT event_id, ts, (event_id % 7)::INTEGER AS attempt FROM behaviour WHERE kind = 'report'),
    j AS (SELECT *, ('0x' || substr(sha256(event_id || chr(31) || attempt), 1, 8))::BIGINT % 1001 AS jitter, ([1, 5, 30, 120, 720])[greatest(1, least(attempt, 5))] * 60000 AS base FROM w)
    SELECT event_id, attempt, CASE WHEN attempt >= 6 THEN 'EXHAUSTED' WHEN attempt = 0 THEN 'READY' ELSE 'SCHEDULED' END AS state,
    CASE WHEN attempt BETWEEN 1 AND 5 THEN base + base * jitter // 10000 END AS delay_ms FROM j""",
    ("behaviour",),
)
def retry_schedule(d: Domain) -> DataFrame:
    """Back-off with up to 10 % of deterministic jitter in whole milliseconds; the sixth attempt is the last."""
    rows = d.behaviour.filter("kind = 'report'").select("event_id", (F.col("event_id") % 7).cast("int").alias("attempt"))
    jitter = F.conv(F.substring(F.sha2(F.concat(F.col("event_id").cast("string"), F.lit("\x1f"), F.col("attempt").cast("string")), 256), 1, 8), 16, 10).cast("long") % 1001
    base = F.element_at(F.array(*map(F.lit, BACKOFF)), F.greatest(F.lit(1), F.least("attempt", F.lit(5)))).cast("long") * 60000
    state = F.when(F.col("attempt") >= 6, "EXHAUSTED").when(F.col("attempt") == 0, "READY").otherwise("SCHEDULED")
    rows = rows.withColumns({"base": base, "jitter": jitter})
    return rows.select("event_id", "attempt", state.alias("state"), F.when(F.col("attempt").between(1, 5), F.col("base") + F.expr("base * jitter div 10000")).alias("delay_ms"))


@query(
    "claim_batch",
    f"""WITH w AS (SELECT event_id, post_id % 5 AS queue, ts AS ready_at, CASE event_id % 3 WHEN 0 THEN 'READY' WHEN 1 THEN 'CLAIMED' ELSE 'DONE' END AS state, ts + INTERVAL 1 MINUTE AS lease FROM behaviour WHERE kind = 'report'),
    r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ready_at, event_id) AS n FROM w WHERE ready_at <= TIMESTAMP '2024-01-15 00:00:00' AND (state = 'READY' OR state = 'CLAIMED' AND lease < TIMESTAMP '2024-01-15 00:00:00'))
    SELECT queue, event_id, n::INTEGER AS place FROM r WHERE n <= 25""",
    ("behaviour",),
)
def claim_batch(d: Domain, size: int = 25) -> DataFrame:
    """Work that is ready or whose lease ran out, first by readiness, per queue."""
    at = F.lit("2024-01-15 00:00:00").cast("timestamp")
    left = F.col("event_id") % 3
    rows = d.behaviour.filter("kind = 'report'").select(
        "event_id", (F.col("post_id") % 5).alias("queue"), F.col("ts").alias("ready_at"),
        F.when(left == 0, "READY").when(left == 1, "CLAIMED").otherwise("DONE").alias("state"), (F.col("ts") + F.expr("interval 1 minute")).alias("lease"),
    )
    free = (F.col("ready_at") <= at) & ((F.col("state") == "READY") | ((F.col("state") == "CLAIMED") & (F.col("lease") < at)))
    w = Window.partitionBy("queue").orderBy("ready_at", "event_id")
    return rows.filter(free).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= size).select("queue", "event_id", "place")


@query(
    "work_states",
    """SELECT post_id, count(*) FILTER (WHERE event_id % 4 = 0) AS ready, count(*) FILTER (WHERE event_id % 4 = 1) AS claimed, count(*) FILTER (WHERE event_id % 4 = 2) AS done,
    count(*) FILTER (WHERE event_id % 4 = 3) AS quarantined, min(ts) AS oldest FROM behaviour GROUP BY post_id""",
    ("behaviour",),
)
def work_states(d: Domain) -> DataFrame:
    return d.behaviour.groupBy("post_id").agg(*(F.count_if(F.col("event_id") % 4 == k).alias(n) for k, n in enumerate(("ready", "claimed", "done", "quarantined"))), F.min("ts").alias("oldest"))


@query(
    "insert_if_absent",
    "SELECT user_id, post_id FROM saves s WHERE NOT EXISTS (SELECT 1 FROM likes l WHERE l.user_id = s.user_id AND l.post_id = s.post_id)",
    ("saves", "likes"),
)
def insert_if_absent(d: Domain) -> DataFrame:
    """The rows that an insert with `do nothing on conflict` would add."""
    return d.saves.join(d.likes, ["user_id", "post_id"], "left_anti")


@query(
    "upsert_newest",
    """SELECT user_id, post_id, kind, event_id AS version, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, post_id, kind ORDER BY event_id DESC) AS n FROM behaviour) WHERE n = 1""",
    ("behaviour",),
)
def upsert_newest(d: Domain) -> DataFrame:
    """The state after upserts that only a higher version may replace; a maximum per key, folded before the shuffle."""
    best = d.behaviour.groupBy("user_id", "post_id", "kind").agg(F.max(F.struct("event_id", "value")).alias("b"))
    return best.select("user_id", "post_id", "kind", F.col("b.event_id").alias("version"), F.col("b.value").alias("value"))


@query(
    "conditional_purge",
    "SELECT kind, count(*) AS purged FROM behaviour WHERE ts < TIMESTAMP '2024-01-10 00:00:00' GROUP BY kind",
    ("behaviour",),
)
def conditional_purge(d: Domain) -> DataFrame:
    return d.behaviour.filter(F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp")).groupBy("kind").agg(F.count("*").alias("purged"))


@query(
    "checkpoint_members",
    """WITH a AS (SELECT DISTINCT post_id FROM behaviour WHERE ts < TIMESTAMP '2024-01-15 00:00:00' AND kind = 'view'),
    b AS (SELECT DISTINCT post_id FROM behaviour WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND kind = 'view')
    SELECT coalesce(a.post_id, b.post_id) AS post_id, CASE WHEN b.post_id IS NULL THEN 'MISSING' WHEN a.post_id IS NULL THEN 'UNEXPECTED' ELSE 'PRESENT' END AS verdict FROM a FULL JOIN b ON a.post_id = b.post_id""",
    ("behaviour",),
)
def checkpoint_members(d: Domain) -> DataFrame:
    """Two sets of members compared: in one pass, by flags per member."""
    rows = d.behaviour.filter("kind = 'view'").withColumn("late", F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp"))
    flags = rows.groupBy("post_id").agg(F.bool_or(~F.col("late")).alias("a"), F.bool_or("late").alias("b"))
    return flags.select("post_id", F.when(~F.col("b"), "MISSING").when(~F.col("a"), "UNEXPECTED").otherwise("PRESENT").alias("verdict"))


@query(
    "json_references",
    """WITH j AS (SELECT user_id, to_json(list({'post': post_id, 'n': n} ORDER BY n DESC, post_id)) AS refs FROM (SELECT user_id, post_id, count(*) AS n FROM behaviour WHERE kind = 'click' GROUP BY 1, 2) GROUP BY user_id),
    x AS (SELECT user_id, unnest(from_json(refs, '[{"post":"BIGINT","n":"BIGINT"}]')) AS r FROM j)
    SELECT user_id, r.post AS post_id, r.n AS n, title FROM x JOIN posts ON posts.post_id = r.post""",
    ("behaviour", "posts"),
)
def json_references(d: Domain) -> DataFrame:
    """A JSON array per member taken apart and joined."""
    counts = d.behaviour.filter("kind = 'click'").groupBy("user_id", F.col("post_id").alias("post")).agg(F.count("*").alias("n"))
    stored = counts.groupBy("user_id").agg(F.to_json(F.collect_list(F.struct("post", "n"))).alias("refs"))
    parsed = stored.select("user_id", F.explode(F.from_json("refs", "array<struct<post:bigint,n:bigint>>")).alias("r"))
    return parsed.select("user_id", F.col("r.post").alias("post_id"), F.col("r.n").alias("n")).join(d.posts.select("post_id", "title"), "post_id")


@query(
    "profile_projection",
    f"""WITH e AS (SELECT * FROM behaviour WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND ts < TIMESTAMP '{NOW}')
    SELECT user_id, count(*) AS events, count(DISTINCT post_id) AS posts, count(*) FILTER (WHERE kind IN ('click', 'save', 'follow')) AS positive, count(*) FILTER (WHERE kind = 'report') AS negative,
    min(ts) AS first_at, max(ts) AS last_at, {_prefixed('user_id', 'count(*)', 'min(event_id)', 'max(event_id)')} AS print FROM e GROUP BY user_id""",
    ("behaviour",),
)
def profile_projection(d: Domain) -> DataFrame:
    """Per member: activity, classified counts, bounds and a fingerprint that names the inputs."""
    rows = d.behaviour.filter((F.col("ts") >= now() - F.expr("interval 30 days")) & (F.col("ts") < now()))
    out = rows.groupBy("user_id").agg(
        F.count("*").alias("events"), F.countDistinct("post_id").alias("posts"), F.count_if(F.col("kind").isin("click", "save", "follow")).alias("positive"),
        F.count_if(F.col("kind") == "report").alias("negative"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"),
    )
    return out.withColumn("print", fingerprint("user_id", "events", "lo", "hi")).drop("lo", "hi")


@query(
    "lineage_rows",
    "SELECT 'user:' || user_id AS snapshot, event_id AS source, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS ordinal FROM behaviour WHERE kind = 'save'",
    ("behaviour",),
)
def lineage_rows(d: Domain) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return d.behaviour.filter("kind = 'save'").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("snapshot"), F.col("event_id").alias("source"), F.row_number().over(w).alias("ordinal"))


@query(
    "snapshot_quality",
    """WITH s AS (SELECT user_id, count(*) AS n FROM behaviour WHERE kind = 'save' AND event_id % 17 <> 0 GROUP BY 1), t AS (SELECT user_id, count(*) AS n FROM behaviour WHERE kind = 'save' GROUP BY 1),
    c AS (SELECT coalesce(s.user_id, t.user_id) AS user_id, coalesce(s.n, 0) AS have, coalesce(t.n, 0) AS want FROM s FULL JOIN t ON s.user_id = t.user_id)
    SELECT user_id, have, want, CASE WHEN have = want THEN 'COMPLETE' WHEN have = 0 THEN 'MISSING' ELSE 'PARTIAL' END AS verdict, CAST(CAST(have AS DECIMAL(20,0)) / want * 100 AS DECIMAL(20,6)) AS score FROM c""",
    ("behaviour",),
)
def snapshot_quality(d: Domain) -> DataFrame:
    """What a snapshot holds against its source, in one pass over both."""
    saves = d.behaviour.filter("kind = 'save'")
    rows = saves.groupBy("user_id").agg(F.count_if(F.col("event_id") % 17 != 0).alias("have"), F.count("*").alias("want"))
    verdict = F.when(F.col("have") == F.col("want"), "COMPLETE").when(F.col("have") == 0, "MISSING").otherwise("PARTIAL")
    score = (F.col("have").cast("decimal(20,0)") / F.col("want") * 100).cast("decimal(20,6)")
    return rows.select("user_id", "have", "want", verdict.alias("verdict"), score.alias("score"))


@query(
    "ratio_metrics",
    """SELECT user_id, count(*) FILTER (WHERE kind = 'click') AS num, count(*) FILTER (WHERE kind = 'view') AS den,
    CASE WHEN count(*) FILTER (WHERE kind = 'view') < 10 THEN 'NOT_APPLICABLE' ELSE 'OK' END AS status,
    CASE WHEN count(*) FILTER (WHERE kind = 'view') >= 10 THEN round(count(*) FILTER (WHERE kind = 'click')::DOUBLE / count(*) FILTER (WHERE kind = 'view'), 9) END AS ratio FROM behaviour GROUP BY user_id""",
    ("behaviour",),
)
def ratio_metrics(d: Domain, least: int = 10) -> DataFrame:
    """A ratio that isn't given below a denominator."""
    rows = d.behaviour.groupBy("user_id").agg(F.count_if(F.col("kind") == "click").alias("num"), F.count_if(F.col("kind") == "view").alias("den"))
    enough = F.col("den") >= least
    return rows.select("*", F.when(enough, "OK").otherwise("NOT_APPLICABLE").alias("status"), F.when(enough, F.round(F.col("num") / F.col("den"), 9)).alias("ratio"))


@query(
    "lineage_integrity",
    """WITH l AS (SELECT event_id AS source, user_id AS snapshot FROM behaviour WHERE kind = 'save' UNION ALL SELECT event_id, user_id FROM behaviour WHERE kind = 'save' AND event_id % 13 = 0 UNION ALL SELECT event_id + 1000000000, user_id FROM behaviour WHERE kind = 'save' AND event_id % 19 = 0),
    g AS (SELECT source, snapshot, count(*) AS n FROM l GROUP BY 1, 2)
    SELECT (SELECT count(*) FROM g LEFT JOIN behaviour b ON b.event_id = g.source WHERE b.event_id IS NULL) AS orphans, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM g WHERE n > 1) AS duplicates, (SELECT count(*) FROM g) AS rows""",
    ("behaviour",),
)
def lineage_integrity(d: Domain) -> DataFrame:
    """Lineage rows without a source, and repeated ones."""
    saves = d.behaviour.filter("kind = 'save'").select(F.col("event_id").alias("source"), F.col("user_id").alias("snapshot"))
    rows = saves.unionByName(saves.filter("source % 13 = 0")).unionByName(saves.filter("source % 19 = 0").withColumn("source", F.col("source") + 1_000_000_000))
    groups = rows.groupBy("source", "snapshot").agg(F.count("*").alias("n"))
    known = d.behaviour.select(F.col("event_id").alias("source"), F.lit(1).alias("known"))
    return groups.join(known, "source", "left").agg(F.count_if(F.col("known").isNull()).alias("orphans"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("rows"))


@query(
    "rebuild_equality",
    """WITH a AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM behaviour GROUP BY 1), b AS (SELECT user_id, sum(n)::BIGINT AS n, max(last) AS last FROM (SELECT user_id, kind, count(*) AS n, max(ts) AS last FROM behaviour GROUP BY 1, 2) GROUP BY 1)
    SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_first, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_second""",
    ("behaviour",),
)
def rebuild_equality(d: Domain) -> DataFrame:
    """Two ways to the same snapshot differ in no row."""
    a = d.behaviour.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    parts = d.behaviour.groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    b = parts.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    both = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(-1))).groupBy("user_id", "n", "last").agg(F.sum("s").alias("s"))
    return both.agg(F.coalesce(F.sum(F.greatest("s", F.lit(0))), F.lit(0)).alias("only_first"), F.coalesce(F.sum(F.greatest(-F.col("s"), F.lit(0))), F.lit(0)).alias("only_second"))


@query(
    "duplicate_representatives",
    """WITH g AS (SELECT user_id, post_id, kind, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first FROM behaviour GROUP BY 1, 2, 3)
    SELECT b.event_id, g.first AS representative, g.n FROM behaviour b JOIN g USING (user_id, post_id, kind) WHERE g.n > 1""",
    ("behaviour",),
)
def duplicate_representatives(d: Domain) -> DataFrame:
    """Events of one identity with the first of them."""
    key = ["user_id", "post_id", "kind"]
    groups = d.behaviour.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("f")).filter("n > 1")
    return d.behaviour.join(groups, key).select("event_id", F.col("f.event_id").alias("representative"), "n")


_STEPS = [(a, b) for a, bs in STEPS.items() for b in bs]


@query(
    "release_steps",
    f"""WITH s AS (SELECT o_custkey AS release, o_orderkey AS step, ({list(STEPS)})[1 + o_orderkey % 6] AS state FROM orders),
    l AS (SELECT *, lag(state, 1, 'DRAFT') OVER (PARTITION BY release ORDER BY step) AS was FROM s)
    SELECT was, state, (was, state) IN ({', '.join(str(x) for x in _STEPS)}) AS allowed, count(*) AS n FROM l GROUP BY 1, 2, 3""",
)
def release_steps(d: Domain) -> DataFrame:
    """Transitions against a table of allowed ones (a few rows, fixed)."""
    states = F.array(*map(F.lit, STEPS))
    s = d.table("orders").select(F.col("o_custkey").alias("release"), F.col("o_orderkey").alias("step"), F.element_at(states, (1 + F.col("o_orderkey") % 6).cast("int")).alias("state"))
    s = s.withColumn("was", F.lag("state", 1, "DRAFT").over(Window.partitionBy("release").orderBy("step")))
    allowed = d.spark.createDataFrame(_STEPS, "was string, state string").withColumn("allowed", F.lit(True))
    counts = s.groupBy("was", "state").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(allowed), ["was", "state"], "left").select("was", "state", F.coalesce("allowed", F.lit(False)).alias("allowed"), "n")
