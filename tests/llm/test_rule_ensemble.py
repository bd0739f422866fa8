from pyspark.sql import functions as F

from tidemark.llm import rule_ensemble as r


def test_rules_of_a_printed_tree():
    text = "Model\n  If (feature 0 <= 1.5)\n   If (feature 1 > 2.0)\n    Predict: 1.0\n   Else (feature 1 <= 2.0)\n    Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 0.0\n"
    assert r.rules_of(text, ["a", "b"]) == [(("a", False, 1.5),), (("a", True, 1.5),), (("a", False, 1.5), ("b", False, 2.0)), (("a", False, 1.5), ("b", True, 2.0))]


def test_learns_junk(spark, docs):
    good = [(k, f"word{k % 7} other{k % 5} " * 3 + " ".join(f"t{k}x{j}" for j in range(60)), 1) for k in range(60)]
    bad = [(100 + k, "spam*** " * (40 + k), 0) for k in range(30)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = r.fit(rows.select("doc_id", "text"), rows.select("doc_id", "quality"))
    got = {x["doc_id"]: x["predicted"] for x in r.classify(rows, model).collect()}
    assert all(got[k] == 1 for k in range(60)) and all(got[100 + k] == 0 for k in range(30))
    scores = [x["score"] for x in r.classify(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)


def test_labels_of_one_class_or_none(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, None), (None, 0), (99999, 0)], "doc_id long, quality int")
    model = r.fit(docs, labels)
    assert not model.weights
    assert {x["score"] for x in r.classify(docs, model).collect()} == {r.classify(docs, model).first()["score"]}
    none = r.fit(docs, labels.filter(F.lit(False)))
    assert abs(r.classify(docs, none).first()["score"] - 0.5) < 1e-9
    assert r.classify(empty, model).count() == 0


def test_scores_are_the_rules_applied_by_hand(spark):
    """op2 on the smallest tables: every score from the ensemble's rules and weights, by Python; what is held out and learnt from."""
    import math
    import zlib

    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    learnt = [row["doc_id"] for row in labels.select("doc_id").collect() if zlib.crc32(str(row["doc_id"]).encode()) % 3 != 1]
    ensemble = r.fit(docs, labels.filter(F.col("doc_id").isin(learnt)))
    assert ensemble.weights
    stats = {row["doc_id"]: row.asDict() for row in r.statistics(docs).collect()}
    got = r.op2(spark, folder).collect()
    assert len(got) == docs.count()
    for row in got:
        x = stats[row["doc_id"]]
        z = ensemble.intercept + sum(w for rule, w in ensemble.weights.items() if all((x[n] > t) if above else (x[n] <= t) for n, above, t in rule))
        assert abs(row["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and row["predicted"] == int(row["score"] >= 0.5)
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)


def test_columns_of_clashing_names_and_null_ids(spark):
    rows = [(i, ("word " * (5 + i % 40)) + "!" * (i % 3), 1, 2.0, "q", 3) for i in range(60)] + [(None, "no id", 1, 2.0, "q", 3), (3, "word " * 8, 1, 2.0, "q", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, y double, label string, quality int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    scored = r.classify(docs, r.fit(docs, labels)).collect()
    assert len(scored) == 62 and all(0 <= row["score"] <= 1 for row in scored)
