"""Leases by hand, and a stream over several batches with its timers."""

from tidemark.streaming import intake, leases
from tidemark.streaming.leases import Command, Work, step

MIN = 60_000


def run(*commands):
    s, out = Work(), []
    for i, (at, kind, more) in enumerate(commands):
        c = Command(i, at, kind, more.get("worker", "worker:a"), more.get("token"), more.get("cls"), more.get("sign", "s"), more.get("release", False), more.get("prepared", False))
        s, accepted, outcome, error, due = step("w", s, c)
        out.append((accepted, outcome or error, due))
    return s, out


def test_a_heartbeat_extends_and_a_stale_claim_is_rejected():
    s, out = run((0, "claim", {}), (59_999, "heartbeat", {"token": 0}), (100_000, "complete", {"token": 9}), (100_000, "complete", {"token": 0, "worker": "worker:b"}), (119_999, "complete", {"token": 0}), (200_000, "claim", {}))
    assert out == [(True, "claimed", MIN), (True, "renewed", 119_999), (False, leases.STALE, None), (False, leases.STALE, None), (False, leases.STALE, None), (True, "reclaimed", 260_000)]
    assert s.token == 5


def test_a_lease_that_ran_out_is_reclaimed():
    s, out = run((0, "claim", {}), (59_999, "claim", {}), (60_000, "claim", {"worker": "worker:b"}), (60_001, "heartbeat", {"token": 0}), (60_001, "complete", {"token": 2, "worker": "worker:b"}), (99_999_999, "claim", {}))
    assert [x for _, x, _ in out] == ["claimed", "NOT_CLAIMABLE", "reclaimed", leases.STALE, "completed", "NOT_CLAIMABLE"]
    assert s.state == leases.COMPLETED


def test_failures_reschedule_exhaust_repeat_or_quarantine():
    commands, at = [], 0
    for k in range(6):
        commands += [(at, "claim", {}), (at + 1, "fail", {"token": 2 * k, "sign": f"s{k}"})]
        at += 1000 * MIN
    s, out = run(*commands)
    assert [x for _, x, _ in out[1::2]] == ["retry_scheduled"] * 5 + ["retry_exhausted"] and s.reason == "retry_exhausted"
    for (_, _, due), at, minutes in zip(out[1::2], range(1, 10**9, 1000 * MIN), leases.BACKOFF, strict=False):
        assert at + minutes * MIN <= due <= at + minutes * MIN * 1.1
    same = [(k * 1000 * MIN + j, kind, {"token": 2 * k}) for k in range(3) for j, kind in enumerate(("claim", "fail"))]
    s, out = run(*same)
    assert [x for _, x, _ in out[1::2]] == ["retry_scheduled", "retry_scheduled", "quarantined"] and s.reason == "repeated_deterministic_failure"
    for cls, reason in (("payload_unmappable", "payload_unmappable"), ("odd", "unclassified_failure")):
        s, out = run((0, "claim", {}), (1, "fail", {"token": 0, "cls": cls}), (2, "review", {"release": True}), (3, "review", {"release": True, "prepared": True}), (4, "review", {}))
        assert s.reason == reason and [x for _, x, _ in out[2:]] == ["RELEASE_PREREQUISITES", "reviewed_release_requested", "reviewed_retain"]
    assert run((0, "review", {}))[1] == [(False, "QUARANTINE_MISSING", None)]


def rows(*commands):
    return [(w, i, at, kind, "worker:a", token, None, "s", False, False) for w, i, at, kind, token in commands]


def test_state_and_timers_over_batches(spark, tmp_path):
    schema = f"work string, {leases.COMMAND}"
    base = 1_700_000_000_000
    batches = [
        rows(("w", 1, base, "claim", None), ("v", 2, base, "claim", None)),
        rows(("w", 3, base + 30_000, "heartbeat", 1), ("v", 4, base + 10_000, "complete", 2)),
        rows(("x", 5, base + 3 * 3_600_000, "claim", None)),  # the watermark passes w's lease
        rows(("x", 6, base + 3 * 3_600_000 + 1, "heartbeat", 5)),  # w's timer goes off
        rows(("w", 7, base + 3 * 3_600_000, "complete", 1), ("w", 8, base + 3 * 3_600_000 + 5, "claim", None)),
    ]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k}"))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = intake.drain(spark, leases.fold_stream(files), "leases-test").collect()
    told = {(r["work"], r["id"]): r["outcome"] or r["error"] for r in got if r["id"] is not None}
    assert told == {
        ("w", 1): "claimed", ("v", 2): "claimed", ("w", 3): "renewed", ("v", 4): "completed", ("x", 5): "claimed", ("x", 6): "renewed", ("w", 7): leases.STALE, ("w", 8): "reclaimed",
    }
    assert [(r["work"], r["at"]) for r in got if r["id"] is None] == [("w", base + 90_000)]
    table = spark.createDataFrame([r for b in batches for r in b], schema)
    assert {(r["work"], r["id"]): r["outcome"] or r["error"] for r in leases.fold(table).collect()} == told


def test_works_share_buckets(spark, tmp_path, monkeypatch):
    """The rows of the state store are no more than the buckets; works that share one keep their own leases, timers and horizons."""
    monkeypatch.setattr(leases, "BUCKETS", 2, raising=False)
    schema, base, day = f"work string, {leases.COMMAND}", 1_700_000_000_000, 86_400_000
    first = [(f"w{k}", 4 * k, base + k, "claim", None) for k in range(60)] + [(f"w{k}", 4 * k + 1, base + 1000 + k, "complete", 4 * k) for k in range(0, 60, 2)]
    batches = [first, *([("x", 1000 + k, base + day * (1 + k), "claim", None)] for k in range(3)), [("w1", 2000, base + 3 * day + 1, "claim", None), ("w0", 2001, base + 3 * day + 2, "claim", None)], *([("x", 3000 + k, base + day * (100 + k), "claim", None)] for k in range(2)), [("w0", 4000, base + 101 * day, "claim", None)]]
    for k, b in enumerate(batches):
        spark.createDataFrame(rows(*b), schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = leases.fold_stream(files).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 2
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    told = {r["id"]: r["outcome"] or r["error"] for r in got if r["id"] is not None}
    want = {4 * k: "claimed" for k in range(60)} | {4 * k + 1: "completed" for k in range(0, 60, 2)} | {1000: "claimed", 1001: "reclaimed", 1002: "reclaimed", 2000: "reclaimed", 2001: "NOT_CLAIMABLE", 3000: "reclaimed", 3001: "reclaimed", 4000: "claimed"}
    assert told == want  # w0, completed, is forgotten after its horizon
    ended = sorted((r["work"], r["at"]) for r in got if r["id"] is None and r["work"].startswith("w") and r["at"] < base + day)
    assert ended == sorted((f"w{k}", base + k + leases.LEASE_MS) for k in range(1, 60, 2))


def test_intake_forgets_after_its_horizon(spark, tmp_path, monkeypatch):
    day = 86_400
    for k, at in enumerate((0, 1, 200, 201, 202)):
        spark.createDataFrame([("k" if k in (0, 1, 4) else f"other{k}", "p", (1000 + at) * day, k)], "key string, print string, s long, event_id long").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    from pyspark.sql import functions as F

    files = spark.readStream.schema("key string, print string, s long, event_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {r["event_id"]: r["outcome"] for r in intake.drain(spark, intake.intake(files.withColumn("ts", F.timestamp_seconds("s"))), "horizon-test").collect()}
    assert got == {0: "NEW", 1: "DUPLICATE", 2: "NEW", 3: "NEW", 4: "NEW"}


def test_intake_keeps_keys_in_buckets(spark, tmp_path, monkeypatch):
    """The rows of the state store, and so the calls of Python, are no more than the buckets; keys that share one keep their own prints and horizons."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(intake, "BUCKETS", 3, raising=False)
    day = 86_400
    first = [(f"k{i % 200}", "p" if i < 400 or i % 2 else "q", 1000 * day + i, i) for i in range(600)]
    batches = [first, [("late", "p", 1200 * day, 600)], [("late", "p", 1201 * day, 601)], [("k0", "q", 1202 * day, 602), ("k0", "q", 1202 * day + 1, 603), ("k0", "p", 1202 * day + 2, 604), ("late", "p", 1202 * day, 605)]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, "key string, print string, s long, event_id long").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    files = spark.readStream.schema("key string, print string, s long, event_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = intake.intake(files.withColumn("ts", F.timestamp_seconds("s"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 3
    got = {r["event_id"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {i: "NEW" if i < 200 else "DUPLICATE" if p == "p" else "CONFLICT" for _, p, _, i in first}
    assert got == want | {600: "NEW", 601: "DUPLICATE", 602: "NEW", 603: "DUPLICATE", 604: "CONFLICT", 605: "DUPLICATE"}


def test_an_empty_table(spark):
    assert leases.fold(spark.createDataFrame([], f"work string, {leases.COMMAND}")).count() == 0
