import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, scoring
from tidemark.operators import rerank
from tidemark.plans import events, experiments
from tidemark.sources import sinks
from tidemark.sources.tables import Domain
from tidemark.streaming import intake

K = lambda dup=None, author=None, region=None, theme=None: (dup, author, region, theme)


def test_diversify_keeps_order_when_nothing_clashes():
    rows = [K(author=str(i), theme=str(i)) for i in range(12)]
    assert [i for i, _, _ in rerank.diversify(rows, rerank.Diversity())] == list(range(12))


def test_diversify_holds_caps_and_bounds():
    rows = [K(author="a") for _ in range(6)] + [K(author=str(i)) for i in range(6)]
    policy = rerank.Diversity(window=4, caps=(1, 2, 4, 3))
    out = rerank.diversify(rows, policy)
    assert sorted(i for i, _, _ in out) == list(range(12))
    assert all(i - 8 <= p <= i + 8 for p, (i, _, _) in enumerate(out))
    first = [rows[i][1] for i, _, _ in out][:4]
    assert first.count("a") == 2


def test_diversify_relaxes_in_order():
    rows = [K(theme="t") for _ in range(6)]
    out = rerank.diversify(rows, rerank.Diversity(window=4))
    assert [r for _, _, r in out][:4] == ["", "", "", "theme"]


def test_forced_at_the_demotion_bound():
    rows = [K(author="a"), K(author="a"), K(author="a")] + [K(author=str(i)) for i in range(20)]
    out = rerank.diversify(rows, rerank.Diversity(window=20, demotion=3, caps=(1, 1, 9, 9)))
    at = {i: p + 1 for p, (i, _, _) in enumerate(out)}
    assert at[1] <= 1 + 1 + 3 and out[at[1] - 1][1] == "FORCED"


def test_explore_inserts_at_slots_and_guards_caps():
    ranked = [K(author=str(i)) for i in range(20)]
    order = rerank.explore(ranked, [K(author="5"), K(author="x"), K(author="y")], rerank.Diversity(caps=(1, 1, 4, 3)))
    assert [p + 1 for p, (o, _) in enumerate(order) if o == "EXPLORATION"] == [6, 16]
    assert [i for o, i in order if o == "EXPLORATION"] == [1, 2]
    assert len(rerank.explore(ranked[:3], [K()], rerank.Diversity())) == 3


def test_bootstrap_interval_covers_a_known_difference():
    rng = np.random.default_rng(0)
    a, b = rng.normal(10, 2, 400).round(1), rng.normal(11, 2, 400).round(1)
    (va, ca), (vb, cb) = (np.unique(x, return_counts=True) for x in (a, b))
    low, high = experiments.bootstrap_interval(ca, va, cb, vb, 7, 4000)
    assert low < b.mean() - a.mean() < high and 0.3 < high - low < 0.8
    assert (low, high) == experiments.bootstrap_interval(ca, va, cb, vb, 7, 4000)


def test_fnv_and_buckets(spark):
    def fnv(s):
        h = 0x811C9DC5
        for b in s.encode():
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        return h

    texts = ["", "a", "ab", "é\x00x", "longer text"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.fnv1a32(F.col("t")).alias("h"), hashing.sampler(F.col("t")).alias("s")).collect()
    assert [r["h"] for r in rows] == [fnv(t) for t in texts]
    assert all(0 <= r["s"] < 10_000 for r in rows)


def test_scores_at_their_edges(spark):
    one = spark.range(1)
    row = one.select(
        scoring.freshness(F.lit(14.0), 14.0).alias("half"), scoring.freshness(F.lit(-1.0), 14.0).alias("future"), scoring.wilson(F.lit(0.0), F.lit(0.0)).alias("none"),
        scoring.time_decay(F.lit(7.0)).alias("seven"), scoring.time_decay(F.lit(91.0)).alias("old"), scoring.clamp(F.lit(-0.0)).alias("zero"),
        scoring.compose({k: F.lit(None).cast("double") for k in scoring.COMPOSITION}).alias("nothing"), scoring.normal_tail(F.lit(1.959964)).alias("p"),
        scoring.low_exposure_boost(F.lit(0), 10, 0.05).alias("boost"),
    ).first()
    assert row["half"] == 0.5 and row["future"] is None and row["none"] is None and row["seven"] == 1.0 and row["old"] == 0.25
    assert str(row["zero"]) == "0.0" and row["nothing"] is None and abs(row["p"] - 0.05) < 1e-4 and row["boost"] == 0.05


def test_as_of_ties_and_misses(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "z", 9)], "e int, k string, at int")
    right = spark.createDataFrame([(10, "k", 5), (11, "k", 5), (12, "k", 3), (13, "k", 6)], "x int, k string, t int")
    got = {r["e"]: r["x"] for r in events.as_of(left, right, ["k"], "at", "t", "x").collect()}
    assert got == {1: 11, 2: None, 3: None}
    strict = {r["e"]: r["x"] for r in events.as_of(left, right, ["k"], "at", "t", "x", strict=True).collect()}
    assert strict == {1: 12, 2: None, 3: None}


def test_merge_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 3), (1, 4, 5), (1, 7, 9), (1, 8, 8)], "k int, lo int, hi int")
    assert sorted((r["lo"], r["hi"], r["parts"]) for r in events.merge_intervals(rows, "k").collect()) == [(0, 5, 2), (7, 9, 2)]


def test_sinks(spark, tmp_path):
    have = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "k int, v int, x string")
    assert sorted(r["k"] for r in sinks.insert_if_absent(new, have, ["k"]).collect()) == [3]
    assert sorted((r["k"], r["x"]) for r in sinks.upsert(have, new, ["k"], "v").collect()) == [(1, "c"), (2, "b"), (3, "e")]
    left, gone = sinks.purge(have, "v > 3")
    assert (left.count(), gone) == (1, 1)
    assert sinks.orphans(new, have, ["k"]).count() == 1
    path = str(tmp_path / "a")
    sinks.append(have, path)
    sinks.append(new, path)
    assert spark.read.parquet(path).count() == 5
    (tmp_path / "f.tsv").write_text("a\tb\n1\tx\n2\t\n")
    assert sinks.read_fixture(spark, str(tmp_path / "f.tsv"), "a int, b string").count() == 2


def test_late_events_are_routed_not_dropped(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 12:00:00"), (3, "2024-01-03 00:00:00")], "e int, a string").withColumn("arrived", F.to_timestamp("a"))
    got = {r["e"]: r["verdict"] for r in intake.route_late(rows, "2024-01-01 00:00:00", "2024-01-02 00:00:00").collect()}
    assert got == {1: "ON_TIME", 2: "WITHIN_TOLERANCE", 3: "REBUILD_REQUIRED"}


def test_radius_is_checked(spark):
    from tidemark.plans import content

    with pytest.raises(ValueError):
        content.regions_nearby(Domain(spark, "/nowhere"), radius=501.0)


def test_text_functions(spark):
    from tidemark.functions import text

    assert text.canonical('{"b": 1.0, "a": [-0.0, {"z": "é", "y": null}]}') == '{"a":[0,{"y":null,"z":"é"}],"b":1}'
    assert text.canonical("{") is None and text.canonical(None) is None
    assert text.has_key('{"a": [{"Pass-Word": 1}]}', frozenset({"password"})) and not text.has_key('{"a": "password"}', frozenset({"password"}))
    assert text.normalise("  Ａ  b\tC ") == "a b c"
    rows = spark.createDataFrame([("a",), (None,), ("é b b B-c",)], "t string")
    got = rows.select("t", text.hmac_bucket(F.col("t"), b"k").alias("h"), text.terms(F.col("t")).alias("w"), text.normalised_query(F.col("t")).alias("q")).collect()
    assert got[1]["h"] is None and 0 <= got[0]["h"] < 10_000 and got[2]["w"] == ["é", "b", "c"] and got[2]["q"] == "é b b b-c"


def test_effects_of_few_and_equal_values(spark):
    rows = [("a", "m", "baseline", 1.0), ("a", "m", "baseline", 2.0), ("b", "m", "baseline", 1.0), ("b", "m", "baseline", 1.0), ("b", "m", "treatment", 1.0), ("b", "m", "treatment", 1.0)]
    rows += [("c", "m", "baseline", 1.0), ("c", "m", "baseline", 1.0), ("c", "m", "treatment", 2.0), ("c", "m", "treatment", 2.0), ("d", "m", "treatment", 3.0), ("d", "m", "baseline", 2.0)]
    got = {r["segment"]: r for r in experiments.effect_columns(spark.createDataFrame(rows, "segment string, metric string, variant string, v double")).collect()}
    assert (got["a"]["nb"], got["a"]["mb"], got["a"]["p"], got["a"]["size"]) == (0, 0.0, 1.0, 0.0)
    assert (got["b"]["p"], got["b"]["size"]) == (1.0, 0.0)
    assert (got["c"]["p"], got["c"]["size"], got["c"]["effect"]) == (0.0, 0.0, 1.0)
    assert got["d"]["p"] == 1.0 and set(got) == {"a", "b", "c", "d", "all"}


def test_holm_takes_all_metrics_of_all_segments_together(spark):
    rows = [("a", "x", 0.01), ("a", "y", 0.04), ("b", "x", 0.03), ("b", "y", 0.5)]
    got = {(r["segment"], r["metric"]): round(r["adjusted"], 9) for r in experiments.holm(spark.createDataFrame(rows, "segment string, metric string, p double")).collect()}
    assert got == {("a", "x"): 0.04, ("b", "x"): 0.09, ("a", "y"): 0.09, ("b", "y"): 0.5}


def metric_rows(spark, spend=0.0, high=0.1, effect=1.0, low=0.5, adjusted=0.01, n=200):
    rows = [("all", "orders", n, n, effect, 0.5, low, low + 1, adjusted), ("all", "spend", n, n, spend, 0.5, spend - 0.01, high, 1.0)]
    df = spark.createDataFrame(rows, "segment string, metric string, na long, nb long, effect double, size double, low double, high double, adjusted double")
    return experiments.performance(experiments.judged(df.selectExpr("*", "na + nb AS n", "0L AS missing")))


@pytest.mark.parametrize(
    ("change", "states", "want"),
    [
        ({}, ("CANARY", "LIVE"), ("PASS", "LIVE", "LIVE")), ({}, ("SHADOW", "CANARY"), ("PASS", "CANARY", "CANARY")), ({}, ("DRAFT", "LIVE"), ("PASS", "HOLD", "HOLD")),
        ({"spend": -0.06, "high": -0.01}, ("CANARY", "LIVE"), ("FAIL", "ROLLBACK", "ROLLED_BACK")), ({"spend": -0.06, "high": -0.01}, ("SHADOW", "CANARY"), ("FAIL", "HOLD", "HOLD")),
        ({"low": -0.1}, ("CANARY", "LIVE"), ("HOLD", "HOLD", "HOLD")), ({"adjusted": 0.06}, ("CANARY", "LIVE"), ("HOLD", "HOLD", "HOLD")), ({"n": 99}, ("ROLLED_BACK", "LIVE"), ("HOLD", "HOLD", "ROLLED_BACK")),
    ],
)
def test_gates_and_decision(spark, change, states, want):
    gated = experiments.gates(metric_rows(spark, **change), approved=True)
    status = {r["gate"]: r["status"] for r in gated.collect()}
    decided = experiments.decision(gated, *states).first()
    assert (status["PERFORMANCE_GUARDRAIL"], decided["decision"], decided["target"]) == want
    assert status["SAMPLE_SUFFICIENCY"] == ("HOLD" if change.get("n") else "PASS")


def test_bootstrap_has_a_segment_of_all(spark):
    rng = np.random.default_rng(4)
    rows = [(s, "m", v, float(rng.normal(10 + (v == "treatment"), 2))) for s in ("a", "b") for v in ("baseline", "treatment") for _ in range(150)]
    df = spark.createDataFrame(rows, "segment string, metric string, variant string, v double")
    got = {r["segment"]: r for r in experiments.bootstrap(df, 1200).collect()}
    assert set(got) == {"a", "b", "all"}
    mean = lambda s, v: np.mean([x for a, _, b, x in rows if b == v and s in (a, "all")])
    for s, r in got.items():
        assert r["low"] < mean(s, "treatment") - mean(s, "baseline") < r["high"]
    assert got["all"]["high"] - got["all"]["low"] < got["a"]["high"] - got["a"]["low"]


def test_decision_of_an_evaluation(spark):
    from tidemark.plans import evaluation

    rows = [(30, 30, 30, 8, 10, 0, 0), (30, 29, 30, 8, 10, 0, 0), (30, 30, 30, 8, 10, 1, 0), (29, 29, 30, 8, 10, 0, 0), (30, 30, 29, 8, 10, 0, 0), (30, 30, 30, 7, 10, 0, 0), (30, 30, 30, 8, 10, 0, 1), (0, 0, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "replays int, exact int, outcomes int, supported int, candidates int, violations int, breaches int")
    got = [r["decision"] for r in evaluation.decide(df.coalesce(1)).collect()]
    assert got == ["PASS", "BLOCK", "BLOCK", *["INSUFFICIENT_EVIDENCE"] * 3, "REVIEW", "INSUFFICIENT_EVIDENCE"]


def test_nearest_rank(spark):
    from tidemark.plans.content import nearest_rank

    rng = np.random.default_rng(2)
    rows = [(g, float(x)) for g, n in (("a", 1000), ("b", 7), ("c", 1)) for x in np.round(rng.exponential(10, n), 1)] + [("d", 5.0)] * 40 + [("a", None)]
    got = {r["g"]: (r["q"], r["n"]) for r in nearest_rank(spark.createDataFrame(rows, "g string, x double"), "g", "x", 0.95, "q", 16).collect()}
    for g in "abcd":
        xs = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (xs[int(np.ceil(0.95 * len(xs))) - 1], len(xs) + (g == "a"))


def test_ranks_of_large_groups_by_ranges(spark):
    from tidemark.operators.ranking import ranked

    rows = [(g, (i * 37) % 101, i) for i in range(300) for g in ("a", "a", None, f"g{i % 5}")]
    rows = [(g, v, n) for n, (g, v, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(5)
    got = {r["id"]: r["rank"] for r in ranked(df, ["g"], [F.desc("v"), F.asc("id")], partitions=7).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))
    assert ranked(df.limit(0), ["g"], [F.asc("v")]).count() == 0


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, other=None: other)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sinks.shared_folder(Session())


def test_composition_by_hand(spark):
    row = spark.range(1).select(
        scoring.compose({"context": F.lit(0.8), "interest": F.lit(0.6), "freshness": F.lit(0.5), "popularity": F.lit(0.2)}).alias("all"),
        scoring.compose({"context": F.lit(None).cast("double"), "interest": F.lit(1.0), "freshness": F.lit(None).cast("double"), "popularity": F.lit(0.0)}).alias("some"),
    ).first()
    assert row["all"] == pytest.approx(0.40 * 0.8 + 0.35 * 0.6 + 0.15 * 0.5 + 0.10 * 0.2)
    assert row["some"] == pytest.approx(0.40 * 0.5 + 0.35 + 0.15 * 0.5)


def test_engagement_by_hand(spark):
    """100 exposures, 10 likes, 5 saves, no shares, with the reference exposure of each type."""
    import math

    def wilson(k, n=100, z=1.96):
        p = k / n
        return (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)

    mean = 0.25 * wilson(10) + 0.5 * wilson(5) + 0.25 * wilson(0)
    got = {
        r["type"]: r["score"]
        for r in spark.createDataFrame([("POST", 100), ("JOURNEY", 100), ("PLACE", 100), ("POST", 19)], "type string, n long")
        .select(F.when(F.col("n") < 20, "few").otherwise(F.col("type")).alias("type"), scoring.engagement(F.col("n"), {"likes": F.lit(10), "saves": F.lit(5), "shares": F.lit(0)}, F.col("type")).alias("score"))
        .collect()
    }
    assert got["POST"] == pytest.approx(mean * (0.75 + 0.25 * math.log(101) / math.log(501)))
    assert got["JOURNEY"] == pytest.approx(mean * (0.75 + 0.25 * math.log(101) / math.log(201)))
    assert got["PLACE"] is None and got["few"] is None


@pytest.mark.parametrize("seed", range(3))
def test_components_match_a_disjoint_set(spark, seed, monkeypatch):
    import random

    from tidemark.operators import components, keyed

    monkeypatch.setattr(keyed, "HOT", 6)
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000, 1000 + k) for k in range(40)] + [(2000 + k, 2001 + k) for k in range(70)] + [(5, 5), (7000, 7000)]
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_resolving_exposures(spark):
    from tidemark.plans import exposures as x

    rows = [
        # a chain: 1-2 share an event, 2-3 a key, so 3 shares nothing with 1
        (1, "a", "p", "r1", 1, "x"), (2, "a", "q", "r1", 2, "x"), (3, "b", "q", "r1", 3, "x"),
        (4, "c", "s", "r2", 9, "x"), (5, "c", "s", "r2", 8, "x"),  # both, the earlier one stands for them
        (6, "d", "t", "r3", 1, "x"), (7, "d", "u", "r3", 1, "y"),  # one event, two payloads
        (8, "e", "v", "r4", 1, "x"), (9, "f", "v", "r4", 1, "y"), (10, "f", "w", "r4", 1, "y"),  # one key, two payloads, one row beyond
        (11, "g", "1", "r5", 1, "x"), (12, "h", "2", "r5", 1, "x"),  # a run that changed
        (13, None, "n", "r6", 1, "x"), (14, None, "n", "r6", 1, "x"), (15, None, "o", "r6", 1, "x"),
    ]
    df = spark.createDataFrame([(i, e, k, r, at, "t", p, "v2" if i == 12 else "v1") for i, e, k, r, at, p in rows], "idx long, event string, key string, run string, at long, text string, print string, invariant string")
    got = {r["idx"]: (r["representative"], r["outcome"]) for r in x.resolve(df).collect()}
    assert got == {
        1: (1, x.KEPT), 2: (1, x.SAME_EVENT), 3: (1, x.AMBIGUOUS), 4: (5, x.BOTH), 5: (5, x.KEPT),
        6: (6, "EVENT_ID_CONFLICT"), 7: (6, "EVENT_ID_CONFLICT"),
        8: (8, "IDEMPOTENCY_KEY_CONFLICT"), 9: (8, "IDEMPOTENCY_KEY_CONFLICT"), 10: (8, "IDEMPOTENCY_KEY_CONFLICT"),
        11: (11, "RECOMMENDATION_RUN_CONFLICT"), 12: (12, "RECOMMENDATION_RUN_CONFLICT"), 13: (13, x.KEPT), 14: (13, x.SAME_KEY), 15: (15, x.KEPT),
    }


def test_lines_and_orders_meet_in_tasks_by_their_number(spark, tmp_path, monkeypatch):
    """However many lines there are, the join's tasks have about LINES_A_TASK; the rows are the same."""
    from tidemark.sources import tables

    spark.range(400).selectExpr("id div 4 as l_orderkey", "id % 7 as l_partkey", "id % 5 as l_suppkey", "cast(id % 4 as int) as l_linenumber", "1.0 as l_quantity", "1.0 as l_extendedprice", "0.0 as l_discount", "0.0 as l_tax", "'R' as l_returnflag", "timestamp'2024-01-01' as l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(90).selectExpr("id as o_orderkey", "id as o_custkey", "timestamp'2024-01-01' as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = sorted(map(tuple, tables.Domain(spark, str(tmp_path)).runs.collect()))
        monkeypatch.setattr(tables, "LINES_A_TASK", 20, raising=False)
        runs = tables.Domain(spark, str(tmp_path)).runs
        assert sorted(map(tuple, runs.collect())) == want and len(want) == 360
        assert runs.rdd.getNumPartitions() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_resolving_follows_only_rows_that_join_two_groups(spark, monkeypatch):
    """Against a disjoint set, with hot groups; rows whose event or key is theirs alone are no edges."""
    import random

    from tidemark.operators import components, keyed
    from tidemark.plans import exposures as x

    monkeypatch.setattr(keyed, "HOT", 4)
    edges, real = [], components.components

    def counted(e):
        edges.append(e.count())
        return real(e)

    monkeypatch.setattr(components, "components", counted)
    monkeypatch.setattr(x, "components", counted, raising=False)
    rng = random.Random(5)
    some = lambda head, n: None if rng.random() < 0.1 else f"{head}{rng.randrange(n)}"
    rows = [(i, some("e", 60), some("k", 90), "r") for i in range(100)] + [(i, f"one{i}", f"pair{i // 2}", "r") for i in range(100, 140)] + [(i, "hub", f"own{i}", "r") for i in range(140, 160)]
    parent = {}

    def find(n):
        parent.setdefault(n, n)
        while parent[n] != n:
            n = parent[n]
        return n

    for i, e, k, _ in rows:
        for other in ([("e", e)] if e else []) + ([("k", k)] if k else []):
            parent[find(other)] = find(("idx", i))
    first = {}
    for i, e, k, _ in rows:
        if e or k:
            first.setdefault(find(("idx", i)), i)
    df = spark.createDataFrame([(i, e, k, r, i, "t", "p", "v") for i, e, k, r in rows], "idx long, event string, key string, run string, at long, text string, print string, invariant string")
    got = {r["idx"]: r["representative"] for r in x.resolve(df).collect()}
    assert got == {i: first[find(("idx", i))] for i, e, k, _ in rows if e or k}
    both = {i for i, e, k, _ in rows if sum(e == o[1] for o in rows if e) > 1 and sum(k == o[2] for o in rows if k) > 1}
    assert sum(edges) <= len(both)


def test_bootstrap_by_slices_matches_resampling(spark):
    rng = np.random.default_rng(4)
    a, b = rng.gamma(2.0, 3.0, 700), rng.gamma(2.2, 3.0, 500)
    rows = [("s", "spend", "baseline", float(v)) for v in a] + [("s", "spend", "treatment", float(v)) for v in b]
    df = spark.createDataFrame(rows, "segment string, metric string, variant string, v double")
    n = 4000
    effects = np.sort([rng.choice(b, len(b)).mean() - rng.choice(a, len(a)).mean() for _ in range(n)])
    low, high = experiments.places(n)
    error = 4 * 2.5 * effects.std() / np.sqrt(n)  # of a tail quantile of n resamples, four times over
    for values in (40, 10_000):  # many slices in several bands, and one slice
        for r in experiments.bootstrap(df, n, values).collect():
            assert abs(r["low"] - effects[low]) < error and abs(r["high"] - effects[high]) < error
    one = experiments.bootstrap(df.filter("variant = 'baseline'"), 100).collect()
    assert {(r["low"], r["high"]) for r in one} == {(0.0, 0.0)}


def test_slices_of_a_resample_add_up(spark):
    """Every resample of a group draws as many values as the group has: with all values 1 each mean is 1."""
    rows = [("s", "m", v, 1.0 + 0 * i) for i in range(50) for v in ("baseline", "treatment")] + [("s", "m", "treatment", 1.0 + k * 1e-12) for k in range(1, 60)]
    df = spark.createDataFrame(rows, "segment string, metric string, variant string, v double")
    assert all(abs(r["low"]) < 1e-9 and abs(r["high"]) < 1e-9 for r in experiments.bootstrap(df, 600, 4).collect())


def test_sums_of_draws_with_frequent_and_rare_values():
    """Frequent values are drawn as numbers of times, rare ones one by one: together as draws from all, also of none, of rare or of frequent values alone."""
    values, counts = np.array([1.0, 2.0, 5.0, 9.0, 40.0]), np.array([1, 900, experiments.FEW, experiments.FEW + 1, 3])
    draws = np.tile([0, 1, 500, 0], 5000)
    for part in (slice(None), slice(1, 2), slice(2, 3)):
        v, c = values[part], counts[part]
        got = experiments.sums(np.random.default_rng(3), c, v, draws)
        mean = (v * c).sum() / c.sum()
        var = (v * v * c).sum() / c.sum() - mean**2
        assert (got[draws == 0] == 0).all() and set(got[draws == 1]) == set(v)
        many = got[draws == 500]
        assert abs(many.mean() - 500 * mean) <= 5 * np.sqrt(500 * var / len(many)) + 1e-9 and abs(many.var() - 500 * var) <= 500 * var * 5 * np.sqrt(2 / len(many)) + 1e-9


def test_slices_are_dealt_by_number(spark):
    """Slices hold few bytes, which must not bring them together in one task."""
    rows = [("s", "m", v, float(i)) for i in range(400) for v in ("baseline", "treatment")]
    found = experiments.bootstrap(spark.createDataFrame(rows, "segment string, metric string, variant string, v double"), 20, 4)
    assert "REPARTITION_BY_NUM" in (plan := found._jdf.queryExecution().toString()) and plan.count("hashpartitioning(segment") >= 2
    assert found.count() == 2


def test_exact_quantiles_however_values_lie(spark):
    from tidemark.plans import content

    rng = np.random.default_rng(6)
    values = np.concatenate((rng.gamma(2.0, 1.0, 5000), [1e6 * 2.0], np.full(300, 1.5)))
    rows = [("a", float(v)) for v in values] + [("b", float(v)) for v in range(10)] + [(None, 4.0), (None, 2.0), ("none", None), ("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for q in (0.01, 0.5, 0.95, 1.0):
        got = {r["g"]: (r["p"], r["n"]) for r in content.nearest_rank(df, "g", "v", q, "p", few=50, slices=8).collect()}
        place = lambda x: np.sort(x)[max(1, int(np.ceil(q * len(x) - 1e-9))) - 1]  # noqa: B023, E731
        assert got["a"] == (place(values), len(values)) and got["b"] == (place(np.arange(10.0)), 10)
        assert got[None] == (place(np.array([2.0, 4.0])), 2) and got["none"] == (None, 1) and got["one"] == (7.0, 1)


def test_interval_left_join_keeps_ends_and_misses(spark):
    from tidemark.operators.intervals import interval_left_join

    t = lambda df, *cs: df.withColumns({c: F.timestamp_seconds(c) for c in cs})
    left = t(spark.createDataFrame([(1, "u", 100, 200), (2, "u", 150, 151), (3, "v", 0, 10), (4, "u", 300, 300), (5, "u", None, 500), (6, None, 0, 900), (7, "u", -50, 1000)], "id int, who string, lo long, hi long"), "lo", "hi")
    right = t(spark.createDataFrame([("u", 100, "start"), ("u", 199, "in"), ("u", 200, "end"), ("u", 150, "mid"), ("v", 10, "after"), (None, 5, "none"), ("u", -50, "early")], "who string, at long, what string"), "at")
    for width in (7, 60, 10_000):
        got = sorted((r["id"], r["what"]) for r in interval_left_join(left, right, ["who"], ["id"], "lo", "hi", "at", width).select("id", F.coalesce("what", F.lit("-")).alias("what")).collect())
        assert got == sorted(
            [(1, "start"), (1, "in"), (1, "mid"), (2, "mid"), (3, "-"), (4, "-"), (5, "-"), (6, "-"), *((7, w) for w in ("start", "in", "end", "mid", "early"))]
        )


def test_fingerprints_know_rows_but_no_order(spark):
    from tidemark.operators.fingerprint import table_fingerprint

    rows = [(i % 3, i, None if i % 7 == 0 else f"t{i % 5}") for i in range(200)]
    df = spark.createDataFrame(rows, "g long, n long, t string")
    of = lambda x: {r["g"]: r["print"] for r in table_fingerprint(x, "g").collect()}
    whole = of(df)
    assert of(df.repartition(7, "n")) == whole == of(df.orderBy(F.desc("n")).coalesce(1))
    changed = of(df.withColumn("t", F.when(F.col("n") == 9, "other").otherwise(F.col("t"))))
    assert changed[0] != whole[0] and (changed[1], changed[2]) == (whole[1], whole[2])
    assert of(df.withColumn("t", F.coalesce("t", F.lit(""))))[0] != whole[0]  # null isn't empty
    assert of(df.unionByName(df.filter("n = 4")))[1] != whole[1]  # a row twice


def test_adapter_measures_by_hand(spark):
    from tidemark.plans.platform import adapter_measures

    runs = spark.sql("select * from values (1, 'a', 'v1', 'mapped', timestamp'2024-01-01', timestamp'2024-01-02'), (2, 'a', 'v1', 'mapped', timestamp'2024-01-03', null), (3, 'b', null, 'failure', timestamp'2024-01-31 23:59:59.5', null) t(run, adapter_version, target_contract_version, evidence_kind, created_at, completed_at)")
    seen = spark.sql("select * from values (1, 2, true, 'EXACT', null), (1, 0, true, 'EXACT', 'E1'), (1, 1, false, null, null), (9, 5, true, 'EXACT', 'E1') t(run, duplicates, conflict, compatibility_class, failure_code)")
    got = {(r["adapter_version"], r["metric_name"], r["dimension_value"]): r["metric_value"] for r in adapter_measures(runs, seen).collect()}
    assert got == {
        ("a", "run_count", None): 2, ("a", "success_count", None): 2, ("a", "new_count", None): 2, ("a", "duplicate_count", None): 3, ("a", "conflict_count", None): 2, ("a", "oldest_run_age_seconds", None): 31 * 86400, ("a", "latest_processed_at", None): None,
        ("a", "compatibility_class_count", "EXACT"): 2, ("a", "failure_code_count", "E1"): 1, ("b", "run_count", None): 1, ("b", "failure_count", None): 1, ("b", "new_count", None): 1, ("b", "duplicate_count", None): 0, ("b", "conflict_count", None): 0,
        ("b", "oldest_run_age_seconds", None): 0, ("b", "latest_processed_at", None): None,
    }
    assert adapter_measures(runs.limit(0), seen).count() == 0
