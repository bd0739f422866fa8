"""Profile projection: failures in order, windows, ranked references, repeats."""

import hashlib
from datetime import datetime, timedelta

from tidemark.operators.fingerprint import fold, row_hash, row_text
from tidemark.plans import profiles as p

NOW = datetime(2024, 2, 1)
SOURCES = "batch long, ref string, print string, form string, contract string, state string, evidence string, type string, identity string, occurred_at timestamp, region string, content string, tags array<string>"


def source(batch, ref, ago=timedelta(days=1), **changes):
    row = {"batch": batch, "ref": ref, "form": ref, "contract": "c1", "state": "MAPPED", "evidence": f"a{ref}", "type": "post_view", "identity": "user:1", "occurred_at": NOW - ago, "region": None, "content": None, "tags": []} | changes
    return tuple(row.get(c, hashlib.sha256(row["form"].encode()).hexdigest()) for c in (x.split()[0] for x in SOURCES.split(", ")))


def project(spark, sources, definitions=(), identities=None, checkpoints=None):
    """definitions: changes of a batch's definition."""
    table = spark.createDataFrame(sources, SOURCES)
    prints = {r["batch"]: r["p"] for r in table.select("batch", "ref", "print").distinct().groupBy("batch").agg(fold(row_hash(row_text("ref", "print"))).alias("p")).collect()}
    base = {"schema": p.SCHEMA, "source_contract": "c1", "version": "b1", "as_of": NOW}
    changes = dict(definitions)
    rows = [(b, *(base | changes.get(b, {})).values(), (checkpoints or {}).get(b, prints.get(b, "0:0:0"))) for b in sorted({*prints, *changes})]
    defined = spark.createDataFrame(rows, "batch long, schema string, source_contract string, version string, as_of timestamp, checkpoint_print string")
    known = spark.createDataFrame(identities or [(b, "user:1", "subject:one", "b1") for b in {*prints, *changes}], "batch long, identity string, subject string, version string")
    return p.project_profiles(defined, table, known)


def test_failures(spark):
    day = lambda k: timedelta(days=k)
    sources = [source(k, "x") for k in (1, 2, 5)]
    sources += [source(3, "x"), source(3, "x", evidence="other"), source(4, "x", ago=day(91))]
    # the first source that fails by time tells, not the first of the rules
    sources += [source(6, "a", contract="c0"), source(6, "b", ago=day(2), state="REJECTED"), source(7, "a", state="REJECTED"), source(7, "b", state="CONFLICTED")]
    sources += [source(8, "a", form="y", print="0" * 64), source(9, "a", ago=day(0)), source(10, "a", state="UNSUPPORTED"), source(11, "a", identity="user:2"), source(12, "a", contract=None, state="REJECTED"), source(14, "a", identity=None)]
    known = [(b, "user:1", "subject:one", "b1") for b in range(1, 15) if b != 13] + [(5, "user:1", "subject:two", "b1"), (1, "user:1", "subject:one", "b1"), (13, "user:1", "subject:one", "b0")]
    sources += [source(13, "a")]
    batches, records, lineage = project(spark, sources, {2: {"schema": "another"}, 20: {}}, known, {1: "1:2:3"})
    assert {r["batch"]: (r["code"], r["detail"]) for r in batches.collect()} == {
        1: ("SOURCE_CHECKPOINT_INVALID", "source_set"), 2: ("UNSUPPORTED_PROJECTION_SCHEMA", "profile_schema"), 3: ("PROJECTION_INVARIANT_FAILED", "duplicate_conflict"), 4: ("LINEAGE_INCOMPLETE", "no_window_lineage"),
        5: ("IDENTITY_NAMESPACE_CONFLICT", "binding_conflict"), 6: ("ADAPTER_EVIDENCE_REJECTED", "rejected"), 7: ("ADAPTER_EVIDENCE_REJECTED", "rejected"), 8: ("SOURCE_FINGERPRINT_MISMATCH", "fingerprint"), 9: ("SOURCE_CHECKPOINT_INVALID", "future_event"),
        10: ("UNSUPPORTED_SOURCE_SCHEMA", "unsupported"), 11: ("IDENTITY_BINDING_REQUIRED", "binding_required"), 12: ("UNSUPPORTED_SOURCE_SCHEMA", "schema_version"), 13: ("IDENTITY_BINDING_REQUIRED", "binding_required"),
        14: ("IDENTITY_BINDING_REQUIRED", "binding_required"), 20: ("SOURCE_EVENT_MISSING", "no_included_event"),
    }
    assert records.count() == lineage.count() == 0


def test_records(spark, monkeypatch):
    monkeypatch.setattr("tidemark.operators.keyed.HOT", 5)  # the batch is joined by a broadcast
    edge = timedelta(days=7)
    rows = [source(1, "in", ago=edge, region="r1", type="post_like"), source(1, "out", ago=edge + timedelta(microseconds=1), region="r2", type="follow"), source(1, "far", ago=timedelta(days=90), type="post_hide", region="r2")]
    rows += [source(1, f"c{k}", ago=timedelta(hours=k + 1), content=f"post:{k}", tags=["t", f"t{k % 2}"], identity="subject:one") for k in range(25)]
    rows += [source(1, "again", ago=timedelta(days=3), content="post:24"), source(1, "other", identity="subject:two", type="tag_click")]
    batches, records, lineage = project(spark, rows + rows[:4])
    assert [(r["batch"], r["code"]) for r in batches.collect()] == [(1, None)]
    found = {(r["subject"], r["days"]): r for r in records.collect()}
    assert sorted(found) == [(s, d) for s in ("subject:one", "subject:two") for d in p.DAYS]
    week, month, all_ = (found["subject:one", d] for d in p.DAYS)
    assert (week["n_sources"], month["n_sources"], all_["n_sources"]) == (27, 28, 29)
    assert (week["regions"], month["regions"], all_["regions"]) == ("r1*1", "r1*1,r2*1", "r2*2,r1*1")
    # by count, then the last time: post:24 twice, then the most recent, and no more than listed
    assert week["contents"] == ",".join(["post:24*2", *(f"post:{k}*1" for k in range(p.LISTED - 1))])
    assert week["tags"] == "t*25,t0*13,t1*12"
    assert (all_["interactions"], all_["positive"], all_["negative"]) == ("follow=1,post_hide=1,post_like=1,post_view=26", "follow=1,post_like=1", "post_hide=1")
    assert (all_["n_positive"], all_["n_negative"]) == (2, 1)
    assert len({r["lineage_print"] for r in found.values()}) == 4  # subject:two has the same lineage in all windows
    assert {r["ref"] for r in lineage.filter("subject = 'subject:one' and days = 7").collect()} == {r[1] for r in rows} - {"out", "far", "other"}
    assert lineage.count() == 27 + 28 + 29 + 3


def test_prints_know_no_order_and_empty_tables_work(spark):
    rows = [source(1, f"s{k}", ago=timedelta(days=k + 1), content=f"post:{k % 3}", tags=["t"]) for k in range(12)]
    prints = [sorted((r["days"], r["lineage_print"], r["record_print"]) for r in project(spark, x)[1].collect()) for x in (rows, rows[::-1] + rows[:5])]
    assert prints[0] == prints[1] and len(prints[0]) == 3
    assert [t.count() for t in project(spark, [], {1: {}})] == [1, 0, 0]
