"""Work under leases: claims, heartbeats, completions, failures and reviews as a fold over each work's commands, in a stream or over tables.

The state of a work is a few values; both forms apply `step` to its commands in order of (at, id). The stream keeps
the states of works by buckets, with timers on event time: one when a lease runs out, which says so, and one HORIZON after the last command, when the
state of a work goes. Over tables, works are dealt by key and read as sorted streams with one state in memory, so a work of
any number of commands is no more than its rows. Times are milliseconds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .intake import bucket

# Length of a lease, minutes until each further attempt, attempts, failures of one signature before, days of evidence.
LEASE_MS = 60_000
BACKOFF = (1, 5, 30, 120, 720)
MOST_ATTEMPTS, SAME_BEFORE = 6, 2
HORIZON_MS = 90 * 86_400_000
#: Works are dealt to so many groups of keyed state; a work has many commands, so fewer than keys of intake have.
BUCKETS = 2_048
REASONS = (
    "schema_unsupported", "source_hash_mismatch", "source_binding_invalid", "payload_unmappable", "payload_too_large", "privacy_policy_violation", "projection_invariant_failed", "lineage_source_missing", "manual_hold",
)
STALE, EXHAUSTED, QUARANTINED = "EVENT_CLAIM_STALE", "EVENT_RETRY_EXHAUSTED", "EVENT_QUARANTINED"
READY, CLAIMED, COMPLETED, HELD = "retry_scheduled", "retry_claimed", "completed", "quarantined"


class Work(NamedTuple):
    state: str = READY
    token: int | None = None
    worker: str | None = None
    lease: int | None = None
    attempt: int = 1
    ready: int = 0
    last: str | None = None
    before: str | None = None
    reason: str | None = None


class Command(NamedTuple):
    """kind: claim, heartbeat, complete, fail or review. A claim's token is its id; failure_class is null where a failure can be tried again."""

    id: int
    at: int
    kind: str
    worker: str
    token: int | None
    failure_class: str | None
    signature: str | None
    release: bool
    prepared: bool


STATE = "state string, token long, worker string, lease long, attempt int, ready long, last string, before string, reason string"
COMMAND = "id long, at long, kind string, worker string, token long, failure_class string, signature string, release boolean, prepared boolean"
#: A work in the state of its bucket.
FIELDS = ", ".join(f"{n}: {t}" for n, t in (x.split() for x in f"work string, {STATE}, seen long, timer long".split(", ")))
OUT = "work string, id long, at long, accepted boolean, outcome string, error string, attempt int, due long"


def delay(work: str, attempt: int) -> int:
    """Back-off with up to 10 % of jitter by the work's name."""
    base = BACKOFF[min(max(attempt, 1), len(BACKOFF)) - 1] * 60_000
    return base + base * (int(hashlib.sha256(f"{work}\x1f{attempt}".encode()).hexdigest()[:8], 16) % 1001) // 10_000


def step(work: str, s: Work, c: Command) -> tuple[Work, bool, str | None, str | None, int | None]:
    """The state after a command, whether it was accepted, its outcome, error, and when the work is due (its lease's end, or when it is ready)."""
    if c.kind == "claim":
        free = (s.state == READY and s.ready <= c.at) or (s.state == CLAIMED and s.lease <= c.at)
        if not free:
            return s, False, None, "NOT_CLAIMABLE", None
        s2 = s._replace(state=CLAIMED, token=c.id, worker=c.worker, lease=c.at + LEASE_MS)
        return s2, True, "reclaimed" if s.state == CLAIMED else "claimed", None, s2.lease
    if c.kind == "review":
        if s.state != HELD:
            return s, False, None, "QUARANTINE_MISSING", None
        if c.release and not c.prepared:
            return s, False, None, "RELEASE_PREREQUISITES", None
        return s, True, "reviewed_release_requested" if c.release else "reviewed_retain", None, None
    if s.state != CLAIMED or s.token != c.token or s.worker != c.worker or s.lease <= c.at:
        return s, False, None, STALE, None
    free = {"token": None, "worker": None, "lease": None}
    if c.kind == "heartbeat":
        return s._replace(lease=c.at + LEASE_MS), True, "renewed", None, c.at + LEASE_MS
    if c.kind == "complete":
        return s._replace(state=COMPLETED, **free), True, COMPLETED, None, None
    same = sum(x is not None and x == c.signature for x in (s.last, s.before))
    marked = {"last": c.signature, "before": s.last} if c.signature is not None else {}
    if c.failure_class is None and s.attempt < MOST_ATTEMPTS and same < SAME_BEFORE:
        due = c.at + delay(work, s.attempt)
        return s._replace(state=READY, attempt=s.attempt + 1, ready=due, **free, **marked), True, READY, None, due
    if c.failure_class is None and s.attempt >= MOST_ATTEMPTS:
        return s._replace(state=HELD, reason="retry_exhausted", **free, **marked), True, "retry_exhausted", EXHAUSTED, None
    reason = "repeated_deterministic_failure" if c.failure_class is None else c.failure_class if c.failure_class in REASONS else "unclassified_failure"
    return s._replace(state=HELD, reason=reason, **free, **marked), True, HELD, QUARANTINED, None


def _commands(frame: pd.DataFrame) -> Iterator[Command]:
    plain = lambda c: [None if x is None or x is pd.NA or x != x else x for x in frame[c].tolist()]
    columns = {c: plain(c) for c in Command._fields}
    columns["token"] = [None if x is None else int(x) for x in columns["token"]]
    return map(Command, *(columns[c] for c in Command._fields))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = [x.split()[0] for x in OUT.split(", ")]
    return pd.DataFrame(rows, columns=columns).astype({"id": "Int64", "at": "Int64", "attempt": "Int32", "due": "Int64", "accepted": "boolean"})


def fold(commands: DataFrame) -> DataFrame:
    """A row per command of a table (work and COMMAND), in OUT."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work, s = None, Work()
        for frame in frames:
            rows = []
            for name, c in zip(frame["work"], _commands(frame), strict=True):
                if name != work:
                    work, s = name, Work()
                s, accepted, outcome, error, due = step(work, s, c)
                rows.append((work, c.id, c.at, accepted, outcome, error, s.attempt, due))
            if rows:
                yield _frame(rows)

    return commands.repartition("work").sortWithinPartitions("work", "at", "id").mapInPandas(run, OUT)


def _stream_step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a bucket is its works', each with when it last had a command and when its timer goes off. A command of a work comes before its timer."""
    works = {w: (Work(*values), seen, timer) for w, *values, seen, timer in state.get[0]} if state.exists else {}
    now, rows, touched = state.getCurrentWatermarkMs(), [], set()
    if not state.hasTimedOut:
        frame = pd.concat(list(frames))
        frame = frame.iloc[np.lexsort((frame["id"], frame["at"]))]
        for work, c in zip(frame["work"], _commands(frame), strict=True):
            s, seen, _ = works.get(work, (Work(), 0, 0))
            s, accepted, outcome, error, due = step(work, s, c)
            works[work] = (s, max(seen, c.at), 0)
            touched.add(work)
            rows.append((work, c.id, c.at, accepted, outcome, error, s.attempt, due))
    for work, (s, seen, timer) in list(works.items()):
        if work in touched:
            timer = s.lease if s.state == CLAIMED and s.lease is not None else seen + HORIZON_MS
            works[work] = (s, seen, max(timer, now + 1))
        elif timer < now and s.state == CLAIMED and s.lease is not None and s.lease <= now < seen + HORIZON_MS:
            works[work] = (s, seen, seen + HORIZON_MS)
            rows.append((work, None, s.lease, True, "lease_expired", None, s.attempt, None))
        elif timer < now:
            del works[work]
    if works:
        state.update(([(w, *s, seen, timer) for w, (s, seen, timer) in works.items()],))
        state.setTimeoutTimestamp(max(min(timer for *_, timer in works.values()), now + 1))
    else:
        state.remove()
    if rows:
        yield _frame(rows)


def fold_stream(commands: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The same of a stream of commands; a lease that runs out gives a row without an id. Commands later than the watermark are dropped."""
    timed = commands.withColumn("_time", F.timestamp_millis("at")).withWatermark("_time", lateness).withColumn("bucket", bucket("work", BUCKETS))
    return timed.groupBy("bucket").applyInPandasWithState(_stream_step, OUT, f"works array<struct<{FIELDS}>>", "append", GroupStateTimeout.EventTimeTimeout)
