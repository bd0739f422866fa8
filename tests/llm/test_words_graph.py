import random

import numpy as np
import pyarrow as pa

from tidemark.llm import graph, words


def test_words_match_splitting():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\té X") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", "x" * (3 << 20), ("long word " * 200_000)]
    raw, offsets = words.batch_bytes(pa.array(texts))
    s, e, h, at = words.word_hashes(raw, offsets)
    want = [(t or "").encode().split() for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert [bytes(raw[a:b]) for a, b in zip(s[:2000], e[:2000], strict=True)] == flat[:2000]
    by = {}
    for x, k in zip(flat, h.tolist(), strict=True):
        assert by.setdefault(x.lower(), k) == k
    assert len(set(by.values())) == len(by)


def test_regular_words_do_not_collide():
    # a Thue-Morse word and its complement collide under any polynomial modulo 2**64
    for k in (8, 10, 12):
        word = "a"
        for _ in range(k):
            word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        _, _, h, _ = words.word_hashes(*words.batch_bytes(pa.array([word, other, word + "a", "a" + word])))
        assert len(set(h.tolist())) == 4


def test_seeds_give_other_hashes():
    raw, offsets = words.batch_bytes(pa.array(["one two three"]))
    assert not set(words.word_hashes(raw, offsets)[2].tolist()) & set(words.word_hashes(raw, offsets, seed=1)[2].tolist())


def test_sliced_batches():
    a = pa.array(["zero", "one two", "three", "four five six"])[1:3]
    raw, offsets = words.batch_bytes(a)
    assert np.diff(words.word_hashes(raw, offsets)[3]).tolist() == [2, 1]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(i + 1, i) for i in range(100, 140)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = lambda rows: spark.createDataFrame(rows, "a long, b long")
    want = {x: find(x) for x in parent}
    assert {r[0]: r[1] for r in graph.components(df(edges)).collect()} == want
    assert {r[0]: r[1] for r in graph.join_components(graph.components(df(edges[:30])), df(edges[30:])).collect()} == want
    assert graph.components(df([])).count() == 0


def test_oracles_are_texts_of_known_queries():
    from tidemark.llm import queries

    assert set(queries.ORACLES) <= set(queries.QUERIES) and all(isinstance(x, str) for x in queries.ORACLES.values())
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
