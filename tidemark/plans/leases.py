"""Work under leases, over tables and as a stream, with behaviour as the workers' commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Domain
from ..streaming import intake, leases
from .registry import ORACLES, query
from .streams import _Streamed

#: Every event is a claim, some a heartbeat, then a completion or failure, sometimes with another's token or worker or after the lease, and some a review.
_COMMANDS = """e AS (SELECT *, epoch_ms(ts) AS t, 'w' || (user_id * 2 + post_id % 2) AS work, 'worker:' || (event_id % 3) AS own FROM behaviour),
    c AS (SELECT work, event_id * 4 AS id, t AS at_, 'claim' AS kind, own AS worker, NULL::BIGINT AS token, NULL AS class, NULL AS signature, false AS release, false AS prepared FROM e
        UNION ALL SELECT work, event_id * 4 + 1, t + 40000, 'heartbeat', own, event_id * 4, NULL, NULL, false, false FROM e WHERE event_id % 3 = 0
        UNION ALL SELECT work, event_id * 4 + 2, t + (20 + event_id % 90) * 1000, CASE WHEN kind = 'save' AND event_id % 16 = 0 THEN 'complete' ELSE 'fail' END, CASE WHEN event_id % 29 = 0 THEN 'worker:other' ELSE own END, CASE WHEN event_id % 17 = 0 THEN -1 ELSE event_id * 4 END,
            CASE WHEN event_id % 61 = 0 THEN 'payload_unmappable' WHEN event_id % 67 = 0 THEN 'unheard_of' END, 's' || (post_id % 5), false, false FROM e
        UNION ALL SELECT work, event_id * 4 + 3, t + 200000, 'review', own, NULL, NULL, NULL, event_id % 2 = 0, event_id % 3 = 0 FROM e WHERE event_id % 11 = 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY at_, id) AS n FROM c)"""


def commands(d: Domain) -> DataFrame:
    e, work = F.col("event_id"), F.concat(F.lit("w"), (F.col("user_id") * 2 + F.col("post_id") % 2).cast("string"))
    t, own, none = F.unix_millis("ts"), F.concat(F.lit("worker:"), (F.col("event_id") % 3).cast("string")), F.lit(None)
    one = lambda k, at, kind, worker=own, token=none, cls=none, sign=none, release=F.lit(False), prepared=F.lit(False): F.struct(
        (e * 4 + k).alias("id"), (t + at).alias("at"), kind.alias("kind"), worker.alias("worker"), token.cast("long").alias("token"), cls.cast("string").alias("failure_class"), sign.cast("string").alias("signature"), release.alias("release"), prepared.alias("prepared")
    )
    claim = one(0, F.lit(0), F.lit("claim"))
    beat = F.when(e % 3 == 0, one(1, F.lit(40_000), F.lit("heartbeat"), token=e * 4))
    last = one(
        2, (20 + e % 90) * 1000, F.when((F.col("kind") == "save") & (e % 16 == 0), "complete").otherwise("fail"), F.when(e % 29 == 0, "worker:other").otherwise(own), F.when(e % 17 == 0, -1).otherwise(e * 4),
        F.when(e % 61 == 0, "payload_unmappable").when(e % 67 == 0, "unheard_of"), F.concat(F.lit("s"), (F.col("post_id") % 5).cast("string")),
    )
    review = F.when(e % 11 == 0, one(3, F.lit(200_000), F.lit("review"), release=e % 2 == 0, prepared=e % 3 == 0))
    return d.behaviour.select(work.alias("work"), F.inline(F.array_compact(F.array(claim, beat, last, review))))


_VALID = "st = 'retry_claimed' AND tok IS NOT DISTINCT FROM o.token AND wk = o.worker AND lease > o.at_"
_SAME = "coalesce((s1 = o.signature)::INTEGER, 0) + coalesce((s2 = o.signature)::INTEGER, 0)"
_BASE = "([1, 5, 30, 120, 720])[greatest(1, least(attempt, 5))]::BIGINT * 60000"
_DELAY = f"({_BASE} + {_BASE} * (('0x' || substr(sha256(o.work || chr(31) || attempt), 1, 8))::BIGINT % 1001) // 10000)"
_FREE = "(st = 'retry_scheduled' AND ready <= o.at_ OR st = 'retry_claimed' AND lease <= o.at_)"
_FOLDED = f"""{_COMMANDS},
    f AS (SELECT work, 0::BIGINT AS n, NULL::BIGINT AS id, 0::BIGINT AS at_, 'retry_scheduled' AS st, NULL::BIGINT AS tok, NULL::VARCHAR AS wk, NULL::BIGINT AS lease, 1 AS attempt, 0::BIGINT AS ready, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, false AS accepted, NULL::VARCHAR AS outcome, NULL::VARCHAR AS error FROM (SELECT DISTINCT work FROM c)
    UNION ALL SELECT work, n, id, at_, CASE outcome2 WHEN 'claimed' THEN 'retry_claimed' WHEN 'reclaimed' THEN 'retry_claimed' WHEN 'renewed' THEN st WHEN 'retry_exhausted' THEN 'quarantined' WHEN 'reviewed_retain' THEN st WHEN 'reviewed_release_requested' THEN st ELSE coalesce(outcome2, st) END,
        CASE WHEN kind = 'claim' AND outcome2 IS NOT NULL THEN id WHEN kind IN ('fail', 'complete') AND outcome2 IS NOT NULL THEN NULL ELSE tok END, CASE WHEN kind = 'claim' AND outcome2 IS NOT NULL THEN worker WHEN kind IN ('fail', 'complete') AND outcome2 IS NOT NULL THEN NULL ELSE wk END,
        CASE WHEN kind IN ('claim', 'heartbeat') AND outcome2 IS NOT NULL THEN at_ + 60000 WHEN kind IN ('fail', 'complete') AND outcome2 IS NOT NULL THEN NULL ELSE lease END, attempt + CASE WHEN outcome2 = 'retry_scheduled' THEN 1 ELSE 0 END, CASE WHEN outcome2 = 'retry_scheduled' THEN at_ + wait ELSE ready END,
        CASE WHEN kind = 'fail' AND outcome2 IS NOT NULL THEN signature ELSE s1 END, CASE WHEN kind = 'fail' AND outcome2 IS NOT NULL THEN s1 ELSE s2 END, outcome2 IS NOT NULL,
        outcome2, CASE WHEN outcome2 = 'retry_exhausted' THEN 'EVENT_RETRY_EXHAUSTED' WHEN outcome2 = 'quarantined' THEN 'EVENT_QUARANTINED' WHEN outcome2 IS NOT NULL THEN NULL WHEN kind = 'claim' THEN 'NOT_CLAIMABLE' WHEN kind = 'review' THEN CASE WHEN st <> 'quarantined' THEN 'QUARANTINE_MISSING' ELSE 'RELEASE_PREREQUISITES' END ELSE 'EVENT_CLAIM_STALE' END
        FROM (SELECT o.work, o.n, o.id, o.at_, o.kind, o.worker, o.signature, st, tok, wk, lease, attempt, ready, s1, s2, {_DELAY} AS wait,
            CASE o.kind WHEN 'claim' THEN CASE WHEN {_FREE} THEN CASE st WHEN 'retry_claimed' THEN 'reclaimed' ELSE 'claimed' END END
                WHEN 'review' THEN CASE WHEN st = 'quarantined' AND NOT o.release THEN 'reviewed_retain' WHEN st = 'quarantined' AND o.prepared THEN 'reviewed_release_requested' END
                WHEN 'heartbeat' THEN CASE WHEN {_VALID} THEN 'renewed' END WHEN 'complete' THEN CASE WHEN {_VALID} THEN 'completed' END
                ELSE CASE WHEN NOT coalesce({_VALID}, false) THEN NULL WHEN o.class IS NULL AND attempt < 6 AND {_SAME} < 2 THEN 'retry_scheduled' WHEN o.class IS NULL AND attempt >= 6 THEN 'retry_exhausted' ELSE 'quarantined' END END AS outcome2
            FROM f JOIN o ON o.work = f.work AND o.n = f.n + 1))"""


@query("work_lifecycle", f"WITH RECURSIVE {_FOLDED} SELECT work, id, accepted, outcome, error, attempt FROM f WHERE n > 0", ("behaviour",))
def work_lifecycle(d: Domain) -> DataFrame:
    """What each command on a work came to."""
    return leases.fold(commands(d)).select("work", "id", "accepted", "outcome", "error", "attempt")


@query("stream_work_lifecycle")
def stream_work_lifecycle(d: Domain) -> DataFrame:
    """The same from a stream of the events."""
    rows = intake.drain(d.spark, leases.fold_stream(commands(_Streamed(d.spark, d.dir))), "leases")
    return rows.filter("id is not null").select("work", "id", "accepted", "outcome", "error", "attempt")


ORACLES["stream_work_lifecycle"] = ORACLES["work_lifecycle"]
