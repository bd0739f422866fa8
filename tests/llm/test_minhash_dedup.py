import numpy as np

from tidemark.llm import minhash_dedup as m


def brute(corpus):
    sets = []
    for i, t, _ in corpus:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if i is not None and j is not None and s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets if i is not None}


def test_components_match_brute_force(docs, corpus):
    got = m.link(docs).collect()
    assert len(got) == len(corpus)
    want = brute(corpus)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_keep_one_keeps_columns_and_rows_without_id(docs, corpus):
    kept = m.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = brute(corpus)
    assert sorted(i for i in set(ids) if i is not None) == sorted(i for i, (_, c) in want.items() if c == i)
    assert None in ids


def test_residual_blocks_find_links_between_components(spark):
    # a chain: each text is near the next only, and the star's centre is near few of them
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(words)))
        words = words[2:] + [f"n{k}a", f"n{k}b"]
    got = {r["doc_id"]: r["component_id"] for r in m.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: c for i, (_, c) in brute([(i, t, None) for i, t in rows]).items()}
    assert got == want and set(want.values()) == {0}


def test_sketch_of_one_shingle_is_full():
    u = np.array([12345678901234567890], dtype=np.uint64)
    assert (m.sketch(u) == u[0]).all()


def test_empty(empty):
    assert m.link(empty).count() == 0
