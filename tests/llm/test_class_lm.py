import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import class_lm as c
from tidemark.llm.common import crc_mod


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_counts_and_base_match_brute_force(docs, corpus):
    counts = Counter()
    for i, t, _ in corpus:
        if not out(i):
            counts.update((t or "").encode().lower().split() + [None])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (i is None, i or 0, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4))
        for i, w in ((i, (t or "").encode().lower().split() + [None]) for i, t, _ in corpus)
    )
    got = c.score(docs, crc_mod("doc_id", 5) == 1).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_rare_words_are_joined(docs, monkeypatch):
    monkeypatch.setattr(c, "UNITS", 20)
    monkeypatch.setattr(c, "WORDS", 30)
    few = {(r["doc_id"], r["n_tokens"]): r["base_score"] for r in c.score(docs, F.lit(False)).collect()}
    monkeypatch.undo()
    many = {(r["doc_id"], r["n_tokens"]): r["base_score"] for r in c.score(docs, F.lit(False)).collect()}
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-6 * max(1, -many[k]) for k in few)


def test_probabilities_of_what_follows_add_up_to_one(spark):
    # every text is one word; the probabilities of each known word, of one unseen word per class, and of the end add up
    rows = [(k, w) for k, w in enumerate(["aa", "bb", "aa", "cc", "aa bb", "bb cc"])]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    got = c.score(train, F.lit(False)).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[0] > by[3]  # the commoner word is likelier


def test_exchange_separates_alternating_words():
    # a and b alternate, as do c and d
    b = np.zeros((4, 4))
    b[0, 1] = b[1, 0] = b[2, 3] = b[3, 2] = 50
    of = c.exchange(b, 4)
    assert len(set(of)) == 4
    merged = c.exchange(np.kron(np.array([[0, 9], [9, 0]]), np.ones((3, 3))), 2)
    assert len(set(merged[:3])) == 1 and len(set(merged[3:])) == 1 and merged[0] != merged[3]


def test_words_beyond_the_units_have_classes_by_their_use(spark, monkeypatch):
    # frequent words follow "the" or "to"; the rare words end alike, and half of them follow "the", half "to"
    monkeypatch.setattr(c, "UNITS", 19)
    monkeypatch.setattr(c, "WORDS", 19)
    rows = [(k, f"the a{k % 8}x was to b{k % 8}y was") for k in range(400)]
    rows += [(400 + k, f"the n{k % 20}zz was to v{k % 20}zz was") for k in range(60)]
    rows += [(1000, "the n7zz was"), (1001, "the v7zz was")]
    got = {r["doc_id"]: r["score"] for r in c.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 1000).collect()}
    assert got[1000] > got[1001] + 0.5


def test_empty(empty):
    assert c.score(empty, F.lit(False)).count() == 0
