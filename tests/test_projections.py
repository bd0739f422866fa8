"""Outcome projections on rows by hand."""

from pyspark.sql import functions as F

from tidemark.plans import projections as p

BOUND = (
    "exposure string, schema string, authority string, source_user string, subject string, version string, variant string, session string, exposed_at timestamp, as_of timestamp, source_contract string, "
    "identity_source string, identity_subject string, identity_version string, starts timestamp, ends timestamp, ingested_until timestamp"
)
SOURCE = (
    "exposure string, ref string, print string, form string, evidence string, state string, type string, identity string, of_exposure string, of_variant string, of_session string, contract string, "
    "occurred_at timestamp, ingested_at timestamp"
)


def bindings(spark, *names, **changed):
    t = lambda day: F.lit(f"2024-01-{day:02d}").cast("timestamp")
    values = {
        "schema": F.lit(p.SCHEMA), "authority": F.lit(p.AUTHORITY), "source_user": F.lit("user:1"), "subject": F.lit("subject:1"), "version": F.lit("b1"), "variant": F.lit("v"), "session": F.lit("s"),
        "exposed_at": t(1), "as_of": t(25), "source_contract": F.lit("c"), "identity_source": F.lit("user:1"), "identity_subject": F.lit("subject:1"), "identity_version": F.lit("b1"),
        "starts": t(1), "ends": t(20), "ingested_until": t(21), **changed,
    }
    return spark.createDataFrame([(n,) for n in names], "exposure string").withColumns(values)


def sources(spark, rows):
    """rows: (exposure, ref, type, day, evidence, {changed})."""
    df = spark.createDataFrame([(e, r, t, ev, f"2024-01-{d:02d}") for e, r, t, d, ev in rows], "exposure string, ref string, type string, evidence string, day string")
    at = F.col("day").cast("timestamp")
    return df.withColumns({
        "form": F.concat_ws("|", "ref", "type"), "print": F.sha2(F.concat_ws("|", "ref", "type"), 256), "state": F.lit("MAPPED"), "identity": F.lit("user:1"), "of_exposure": F.col("exposure"),
        "of_variant": F.lit("v"), "of_session": F.lit("s"), "contract": F.lit("c"), "occurred_at": at, "ingested_at": at,
    }).drop("day")


def projected(spark, b, s):
    known = p.checkpoint_of(p.within(s, b)).select("exposure", F.col("n").alias("checkpoint_n"), F.col("set_print").alias("checkpoint_print"), F.col("last").alias("checkpoint_last"))
    records, lineage = p.project_outcomes(b.join(known, "exposure", "left"), s)
    return {r["exposure"]: r.asDict() for r in records.collect()}, sorted((r["exposure"], r["ref"]) for r in lineage.collect())


def test_records_failures_and_lineage(spark):
    shown = p.EXPOSURE_TYPE
    s = sources(spark, [
        ("a", "1", shown, 1, "x"), ("a", "2", "post_like", 2, None), ("a", "2", "post_like", 2, None), ("a", "3", "post_view", 3, "x"),  # a repeat, and a type that isn't counted
        ("b", "1", shown, 1, "x"), ("b", "2", "post_share", 8, "x"),  # on the end of its window
        ("c", "2", "post_share", 7, "x"),  # never shown
        ("d", "1", shown, 1, "x"),  # without a binding
        ("e", "1", shown, 1, "x"), ("e", "2", "post_like", 22, "x"),  # after the span: not of the set
    ])
    records, lineage = projected(spark, bindings(spark, "a", "b", "c", "e", "f"), s)
    assert {k: (r["code"], r["detail"]) for k, r in records.items()} == {
        "a": (None, None), "b": ("outcome_window_violation", "outside_window"), "c": ("exposure_binding_missing", "source_missing"), "d": ("exposure_binding_missing", "missing"),
        "e": (None, None), "f": ("source_checkpoint_invalid", "source_set"),
    }
    a = records["a"]
    assert (a["liked"], a["clicked"], a["n_outcomes"], a["n_sources"]) == (True, False, 1, 2) and records["b"]["liked"] is None
    assert lineage == [("a", "1"), ("a", "2"), ("e", "1")]


def test_deliveries_that_differ_and_the_first_failure(spark):
    s = sources(spark, [("a", "1", p.EXPOSURE_TYPE, 1, "x"), ("a", "2", "post_like", 2, "x"), ("a", "3", "post_like", 9, "x"), ("a", "4", "post_like", 3, "x")])
    torn = s.unionByName(s.filter("ref = '2'").withColumn("state", F.lit("REJECTED")))
    assert projected(spark, bindings(spark, "a"), torn)[0]["a"]["code"] == "projection_invariant_failed"
    both = s.withColumn("state", F.when(F.col("ref") == "4", "REJECTED").otherwise(F.col("state")))
    assert projected(spark, bindings(spark, "a"), both)[0]["a"]["code"] == "outcome_window_violation"  # source 3 comes before source 4
    both = s.withColumn("state", F.when(F.col("ref") == "2", "CONFLICTED").otherwise(F.col("state")))
    assert projected(spark, bindings(spark, "a"), both)[0]["a"]["code"] == "adapter_evidence_conflicted"


def test_empty_tables(spark):
    none = sources(spark, [("a", "1", "post_like", 1, "x")]).limit(0)
    assert projected(spark, bindings(spark, "a").limit(0), none) == ({}, [])
    assert projected(spark, bindings(spark, "a"), none)[0]["a"]["code"] == "source_checkpoint_invalid"
