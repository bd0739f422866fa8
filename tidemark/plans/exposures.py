"""Exposures as they arrive: repeats under one identity resolved, with conflicts told."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.keyed import left_counted
from ..sources.sinks import stage
from ..sources.tables import Domain
from .events import _prefixed, fingerprint
from .registry import query

#: What is wrong with a group of rows, worst first; (code, the group's column, the column that must be the same all over it).
CONFLICTS = (("EVENT_ID_CONFLICT", "event", "print"), ("IDEMPOTENCY_KEY_CONFLICT", "key", "print"), ("RECOMMENDATION_RUN_CONFLICT", "run", "invariant"))
KEPT, AMBIGUOUS = "KEPT", "AMBIGUOUS_DUPLICATE_IDENTITY_GRAPH"
BOTH, SAME_EVENT, SAME_KEY = "DUPLICATE_IDEMPOTENCY_KEY_AND_EVENT_ID", "DUPLICATE_EVENT_ID", "DUPLICATE_IDEMPOTENCY_KEY"


def conflicts(rows: DataFrame) -> DataFrame:
    """(code, id): groups of one event, key or run whose rows don't agree; least and greatest of each are folded before the shuffle."""
    found = []
    for code, by, same in CONFLICTS:
        groups = rows.filter(F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("id")).agg(F.min(same).alias("lo"), F.max(same).alias("hi"))
        found.append(groups.filter("lo <> hi").select(F.lit(code).alias("code"), "id"))
    return reduce(DataFrame.unionByName, found)


def _sharing(rows: DataFrame, by: str, same: str) -> DataFrame:
    """Values of `by` in more rows than one: the least idx of theirs, how many they are, and whether they don't agree in `same`."""
    groups = rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min("idx").alias(f"{by}_least"), F.count("*").alias(f"{by}_n"), (F.min(same) != F.max(same)).alias(f"{by}_bad"))
    return groups.filter(f"{by}_n > 1")


def resolve(rows: DataFrame) -> DataFrame:
    """Adds component, representative (idx of its first row by time, text, event, key and idx) and outcome to rows, in place of print and invariant.

    rows: idx (no two alike), event, key, run, at, text, print (of the payload), invariant (of the run). Rows that share an event or a key are a
    component, through any number of others; one without either is left out. Where groups in conflict meet a component, all its rows have the worst
    code. Else the first row is kept; another one names what it shares with the first, and one that shares nothing with it is ambiguous.

    A group's least idx stands for it. Only rows whose event and key both have further rows can join two groups, so the edges are those
    of such rows, from number to number. rows is read four times, by its columns: stage one that is costly. Prints don't travel with the rows."""
    met = rows.filter(F.coalesce("event", "key").isNotNull()).drop("print", "invariant")
    for code, by, same in CONFLICTS:
        if by == "run":  # only runs that changed
            runs = rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min(same).alias("lo"), F.max(same).alias("hi"), F.count("*").alias("run_n")).filter("lo <> hi")
            shared = stage(runs.select(by, "run_n", F.lit(True).alias("run_bad")), by)
        else:
            shared = stage(_sharing(rows, by, same), by)
        met = left_counted(met, shared, [by], f"{by}_n")
    own = F.coalesce("event_least", "key_least", "idx")
    worst = F.coalesce(*(F.when(F.col(f"{by}_bad"), i) for i, (_, by, _) in enumerate(CONFLICTS)))
    met = stage(met.select(*(c for c in rows.columns if c not in ("print", "invariant")), own.alias("own"), "event_least", "key_least", worst.alias("worst")), "met")
    edges = met.filter("event_least <> key_least").select(F.col("event_least").alias("a"), F.col("key_least").alias("b"))
    found = components(edges).filter("node <> component").select(F.col("node").alias("own"), "component")
    sizes = met.groupBy("own").agg(F.count("*").alias("n"), F.min("worst").alias("worst"), F.min(F.struct("at", "text", "event", "key", "idx")).alias("first"))
    sizes = stage(sizes.join(found, "own", "left").withColumn("component", F.coalesce("component", "own")), "sizes")
    groups = sizes.groupBy("component").agg(F.min("worst").alias("worst"), F.min("first").alias("first"), F.sum("n").alias("many"))
    groups = stage(left_counted(sizes.select("own", "n", "component"), stage(groups, "groups"), ["component"], "many"), "owns")
    met = left_counted(met.drop("worst"), groups, ["own"], "n")
    code = F.element_at(F.array(*(F.lit(c) for c, *_ in CONFLICTS)), F.col("worst") + 1)
    event, key = F.col("event").eqNullSafe(F.col("first.event")), F.col("key").eqNullSafe(F.col("first.key"))
    event, key = event & F.col("event").isNotNull(), key & F.col("key").isNotNull()
    outcome = F.when(F.col("worst").isNotNull(), code).when(F.col("idx") == F.col("first.idx"), KEPT).when(event & key, BOTH).when(event, SAME_EVENT).when(key, SAME_KEY).otherwise(AMBIGUOUS)
    return met.select(*(c for c in rows.columns if c not in ("print", "invariant")), "component", F.col("first.idx").alias("representative"), outcome.alias("outcome"))


#: Behaviour as exposures sent more than once: eight ids in a row make chains of alternating keys, pairs, or share an event or a key.
_SENT = f"""sent AS (SELECT event_id AS idx, CASE b % 4 WHEN 0 THEN 'e' || b || '.' || ((i + 1) // 2) WHEN 1 THEN 'e' || b || '.' || (i // 2) WHEN 2 THEN 'e' || b || '.' || (i // 4) ELSE 'e' || b || '.' || i END AS event,
        CASE b % 4 WHEN 0 THEN 'k' || b || '.' || (i // 2) WHEN 1 THEN 'k' || b || '.' || (i // 2) WHEN 2 THEN 'k' || b || '.' || i ELSE 'k' || b || '.' || (i // 4) END AS key, 'r' || (b // 3) AS run,
        date_trunc('day', ts) AS served, 't' || (event_id % 3) AS text, {_prefixed('b', 'CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END')} AS print, {_prefixed('(b // 3)', 'CASE WHEN event_id % 2003 = 0 THEN 1 ELSE 0 END')} AS invariant
        FROM (SELECT *, event_id // 8 AS b, event_id % 8 AS i FROM behaviour))"""


def sent(d: Domain) -> DataFrame:
    b, i = F.expr("event_id div 8"), F.col("event_id") % 8
    rows = d.behaviour.withColumns({"b": b, "i": i, "odd": (F.col("event_id") % 97 == 0).cast("int"), "moved": (F.col("event_id") % 2003 == 0).cast("int"), "r": F.expr("event_id div 8 div 3")})
    name = lambda head, part: F.concat(F.lit(head), F.col("b").cast("string"), F.lit("."), F.expr(part).cast("string"))
    case = lambda head, parts: F.when(F.col("b") % 4 == 0, name(head, parts[0])).when(F.col("b") % 4 == 1, name(head, parts[1])).when(F.col("b") % 4 == 2, name(head, parts[2])).otherwise(name(head, parts[3]))
    return rows.select(
        F.col("event_id").alias("idx"), case("e", ("(i + 1) div 2", "i div 2", "i div 4", "i")).alias("event"), case("k", ("i div 2", "i div 2", "i", "i div 4")).alias("key"), F.concat(F.lit("r"), F.col("r").cast("string")).alias("run"),
        F.date_trunc("day", "ts").alias("at"), F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("text"), fingerprint("b", "odd").alias("print"), fingerprint("r", "moved").alias("invariant"),
    )


_RESOLVED = f"""{_SENT}, near AS (SELECT a.idx AS x, b.idx AS y FROM sent a JOIN sent b ON a.event = b.event UNION SELECT a.idx, b.idx FROM sent a JOIN sent b ON a.key = b.key),
    reach AS (SELECT idx AS x, idx AS y FROM sent UNION SELECT reach.x, near.y FROM reach JOIN near ON near.x = reach.y),
    comp AS (SELECT x AS idx, min(y) AS c FROM reach GROUP BY 1),
    firsts AS (SELECT c, arg_min(idx, (served, text, event, key, idx)) AS rep FROM sent JOIN comp USING (idx) GROUP BY 1),
    bad AS (SELECT 0 AS code, event AS id FROM sent GROUP BY event HAVING count(DISTINCT print) > 1 UNION ALL SELECT 1, key FROM sent GROUP BY key HAVING count(DISTINCT print) > 1 UNION ALL SELECT 2, run FROM sent GROUP BY run HAVING count(DISTINCT invariant) > 1),
    worst AS (SELECT c, min(code) AS code FROM sent JOIN comp USING (idx) JOIN bad ON (code = 0 AND id = event) OR (code = 1 AND id = key) OR (code = 2 AND id = run) GROUP BY 1),
    resolved AS (SELECT s.idx, s.event, s.key, f.rep AS representative, CASE w.code WHEN 0 THEN 'EVENT_ID_CONFLICT' WHEN 1 THEN 'IDEMPOTENCY_KEY_CONFLICT' WHEN 2 THEN 'RECOMMENDATION_RUN_CONFLICT' ELSE
        CASE WHEN s.idx = f.rep THEN 'KEPT' WHEN s.event = r.event AND s.key = r.key THEN '{BOTH}' WHEN s.event = r.event THEN '{SAME_EVENT}' WHEN s.key = r.key THEN '{SAME_KEY}' ELSE '{AMBIGUOUS}' END END AS outcome
        FROM sent s JOIN comp USING (idx) JOIN firsts f USING (c) JOIN sent r ON r.idx = f.rep LEFT JOIN worst w ON w.c = comp.c)"""


@query("exposure_dedupe", f"WITH RECURSIVE {_RESOLVED} SELECT idx, event, key, representative, outcome FROM resolved", ("behaviour",))
def exposure_dedupe(d: Domain) -> DataFrame:
    """Each exposure with the one that stands for it, or the conflict that keeps its component out."""
    return resolve(sent(d)).select("idx", "event", "key", "representative", "outcome")


@query("exposure_conflicts", f"WITH RECURSIVE {_RESOLVED} SELECT (['EVENT_ID_CONFLICT', 'IDEMPOTENCY_KEY_CONFLICT', 'RECOMMENDATION_RUN_CONFLICT'])[1 + code] AS code, id FROM bad", ("behaviour",))
def exposure_conflicts(d: Domain) -> DataFrame:
    return conflicts(sent(d))


@query(
    "behaviour_duplicates",
    f"WITH RECURSIVE {_RESOLVED} SELECT representative, count(*) AS n, count(*) FILTER (WHERE outcome = '{AMBIGUOUS}') AS ambiguous FROM resolved WHERE outcome NOT LIKE '%CONFLICT' GROUP BY 1 HAVING count(*) > 1",
    ("behaviour",),
)
def behaviour_duplicates(d: Domain) -> DataFrame:
    """Components of repeated behaviour by their representative, with how many rows only others link to it."""
    rows = resolve(sent(d)).filter(~F.col("outcome").endswith("CONFLICT"))
    return rows.groupBy("representative").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == AMBIGUOUS).alias("ambiguous")).filter("n > 1")
