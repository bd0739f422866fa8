from collections import defaultdict

from tidemark.llm import mixing as m


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        new = {s for s in rest if share[s] > 3 * sizes[s]}
        if not new:
            return {s: share.get(s, 3 * sizes[s]) for s in names}
        full |= new


def planned(docs):
    thin = m.sizes(docs).select("doc_id", "_source", "_size", "_h").cache()
    groups, n = m.plan(thin)
    return m.copies_of(thin, groups, n).collect()


def test_targets_and_taken_words(docs):
    docs = docs.dropDuplicates(["doc_id", "text"])  # equal rows are taken together
    rows = planned(docs)
    assert len(rows) == docs.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["_source"]] += r["_size"]
        taken[r["_source"]] += r["copies"] * r["_size"]
        target[r["_source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    for s, t in water_fill(sizes).items():
        assert abs(target[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= max(5, 0.05 * t), s


def test_reruns_agree_and_mix_repeats_rows(docs):
    key = lambda rows: sorted((str(r["doc_id"]), r["_size"], r["copies"]) for r in rows)
    first = planned(docs)
    assert key(first) == key(planned(docs))
    mixed = m.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in first)


def test_equal_sizes_share_copies(spark):
    df = spark.createDataFrame([(k, "a b c d", "x") for k in range(300)] + [(1000 + k, "e f g", "y") for k in range(100)], "doc_id long, text string, source string")
    rows = planned(df)
    copies = [r["copies"] for r in rows if r["_source"] == "x"]
    assert max(copies) - min(copies) <= 1
    assert abs(sum(copies) * 4 - 600) <= 4  # y stops at 900, and the rest goes to x


def test_empty(empty):
    assert m.mix(empty).count() == 0


def test_rates_solve_the_balance(spark):
    # an independent solver: bisection on each source's multiplier, over documents one by one
    import math
    import random

    rng = random.Random(3)
    rows = [(k, " ".join("w" * rng.randint(1, 60)), "abc"[min(2, k // 40)]) for k in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counted = m.sizes(df).groupBy("_source", "_size").agg(m.F.count("*").alias("n"))
    per_source = counted.groupBy("_source").agg(m.F.sum("n").alias("docs"), m.F.sum(m.F.col("n") * m.F.col("_size")).alias("source_size"))
    targets = m.source_targets(per_source)
    counts = counted.join(targets.select("sid", "_source"), "_source").select("sid", "_size", "n")
    for r in m.solve(counts, targets, 3).collect():
        of = [x for x in rows if x[2] == "abc"[r["sid"] - 1]]
        sizes = [len(t.split()) for _, t, _ in of]
        mean = sum(sizes) / len(sizes)
        got = lambda x: sum(s * min(3, math.exp(min(20, x * s / mean))) for s in sizes)  # noqa: B023, E731
        lo, hi = -100.0, 100.0
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if got((lo + hi) / 2) < r["target"] else (lo, (lo + hi) / 2)
        assert abs(got(r["m"]) - r["target"]) < 1e-6 * r["target"]
        if r["target"] < 3 * sum(sizes):
            assert abs(r["m"] - lo) < 1e-6


def test_rounding_against_every_choice(spark):
    # one giant document and a few small ones: no choice of copies may come much nearer to the target
    import random

    rng = random.Random(9)
    state, counts, cases = [], [], {}
    for sid in range(60):
        sizes = {rng.randint(2, 30): rng.randint(1, 4) for _ in range(3)} | {rng.randint(60, 400): 1}
        total = sum(s * n for s, n in sizes.items())
        target = rng.uniform(0.1, 2.9) * total
        cases[sid] = (sizes, target)
        state.append((sid, target, total / sum(sizes.values()), rng.uniform(-1, 1)))
        counts += [(sid, s, n) for s, n in sizes.items()]
    rows = m.round_copies(
        spark.createDataFrame(counts, "sid int, _size long, n long"), spark.createDataFrame(state, "sid int, target double, mean double, m double"), 60
    ).collect()
    taken, most = defaultdict(int), {}
    for r in rows:
        assert 0 <= r["copies"] <= 3 * r["n"] and cases[r["sid"]][0][r["_size"]] == r["n"]
        taken[r["sid"]] += r["_size"] * r["copies"]
    for sid, (sizes, target) in cases.items():
        sums = {0}
        for s, n in sizes.items():
            sums = {x + s * c for x in sums for c in range(3 * n + 1)}
        most[sid] = min(abs(x - target) for x in sums)
        assert abs(taken[sid] - target) <= most[sid] + min(sizes), (sid, sizes, target)


def test_long_lists_of_sizes_are_folded_in_blocks(spark):
    sizes = range(1, 2 * m.FOLD + 90)
    counts = spark.createDataFrame([(1, s, 1) for s in sizes], "sid int, _size long, n long")
    target = 0.4 * sum(sizes)
    state = spark.createDataFrame([(1, target, sum(sizes) / len(sizes), -0.9)], "sid int, target double, mean double, m double")
    rows = m.round_copies(counts, state, 1).collect()
    assert sorted(r["_size"] for r in rows) == list(sizes)
    assert abs(sum(r["_size"] * r["copies"] for r in rows) - target) <= 1


NAMES = ("copies", "target", "last", "each", "source_size", "n", "g_key", "g_size", "g_n", "_source", "_size", "_h", "_doc", "_copy", "_key", "extra", "sid")


def test_columns_of_any_name_stay_as_they_are(spark, monkeypatch):
    texts = ["a b c d", "a b", "", None, "one two three", "a b c d"]
    rows = [(i, texts[i % 6], ("x", "y", None)[i % 3], *(1000 * k + i for k in range(len(NAMES)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in NAMES))
    whole = {r["doc_id"]: tuple(r) for r in df.collect()}
    found = m.mix(df).collect()
    assert found and all(tuple(r) == whole[r["doc_id"]] for r in found)
    want = sorted(r["doc_id"] for r in found)
    monkeypatch.setattr(m, "BROADCAST_ROWS", 2)  # groups joined by a shuffle, the large ones aside
    monkeypatch.setattr("tidemark.llm.common.HOT", 8)
    found = m.mix(df).collect()
    assert sorted(r["doc_id"] for r in found) == want and all(tuple(r) == whole[r["doc_id"]] for r in found)


def test_an_unmet_constraint_is_an_error(docs, monkeypatch):
    import pytest

    monkeypatch.setattr(m, "ROUNDS", 1)
    with pytest.raises(ArithmeticError, match="after 1 rounds"):
        m.mix(docs)
