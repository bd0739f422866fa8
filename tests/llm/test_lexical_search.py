import math
import re
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm import lexical_search as x


def lower(text):
    return text.translate({a: a + 32 for a in range(65, 91)})


def brute(corpus, items, k=10):
    docs = [(i, Counter(re.findall(x.TERM, lower(t or "")))) for i, t in corpus]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(s for *_, s in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    queries = defaultdict(set)
    for item, text in items:
        queries[item] |= set(re.findall(x.TERM, lower(text or "")))
    out = []
    for item, terms in queries.items():
        scores = []
        for i, c, s in docs:
            m = 10 + 90 * s * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def queries(corpus):
    texts = [t for _, t, _ in corpus if t and t.strip()]
    items = [(k, " ".join(t.split()[5:25])) for k, t in enumerate(texts[:30])]
    return items + [(70, None), (71, ""), (72, "--- !"), (73, "the THE The nowhere-else"), (74, "été À ÉTÉ"), (75, texts[3]), (75, "word"), (None, "personal mail bob"), (76, "bob 12 4111111111111111"), (76, "bob 12 4111111111111111")]


def got(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


def test_ranks_match_brute_force(spark, docs, corpus, monkeypatch):
    items = queries(corpus)
    table = spark.createDataFrame([(i, t, 1, 2, "q") for i, t in items], "item_id long, text string, doc_id int, n int, term string")
    want = brute([(i, t) for i, t, _ in corpus], items)
    assert got(x.search(docs, table)) == want
    monkeypatch.setattr(x, "SHARD", 7)  # several shards a task, blocks of queries
    monkeypatch.setattr(x, "PAIRS", 40)
    assert got(x.search(docs, table)) == want
    assert got(x.search(docs, table, k=2)) == brute([(i, t) for i, t, _ in corpus], items, 2)


def test_ties_go_by_id(spark):
    docs = spark.createDataFrame([(i, "alpha beta") for i in (9, 3, 12, 7, 7)] + [(None, "alpha beta"), (1, "other words")], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, "Beta-ALPHA")], "item_id long, text string")
    rows = x.search(docs, items).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [3, 7, 7, 9, 12, None] and len({r["score"] for r in rows}) == 1


def test_a_query_ends_before_all_its_postings():
    rng = np.random.default_rng(3)
    n, terms = 4000, 12
    frequent = rng.random((n, terms)) < np.linspace(0.02, 0.98, terms)
    starts = np.concatenate(([0], np.cumsum(frequent.sum(axis=1))))
    doc, t = np.nonzero(frequent)
    parts = (np.linspace(4000, 10, terms).astype(np.int64)[t]) * rng.integers(400, 1000, len(t))
    shard = x.Shard(np.arange(n), starts, t, parts, terms)
    found, scores = shard.best(np.arange(terms), 10, 1)
    whole = np.bincount(doc, weights=parts, minlength=n).astype(np.int64)
    best = np.lexsort((np.arange(n), -whole))[:10]
    mine = found[np.lexsort((found, -scores))[:10]]
    assert mine.tolist() == best.tolist() and shard.taken < len(t) / 2
    assert not shard.sums.any() and not shard.mine.any()


def test_hash_collisions_are_told_apart_by_bytes(monkeypatch, spark):
    real = x.word_hashes

    def coarse(*a, **k):
        s, e, h, at = real(*a, **k)
        return s, e, h % np.uint64(5) if k.get("seed", 0) == 9 else h, at

    d = x.Dictionary(["ab", "cd", "longer"])
    d.seed = 9
    h = coarse(np.frombuffer(b"ab cd longer", np.uint8), np.array([0, 12]), lower=False, seed=9)[2]
    d.find = x.Lookup(np.unique(h), np.array([0, 1, 2][: len(np.unique(h))]))
    raw = np.frombuffer(b"zz ab longer longest cd", np.uint8)
    s, e, h, _ = coarse(raw, np.array([0, len(raw)]), lower=False, seed=9)
    at, k = d(raw, s, e, h)
    assert all(raw[s[a] : e[a]].tobytes().decode() == ["ab", "cd", "longer"][j] for a, j in zip(at, k, strict=True))


def test_empty(spark, docs, empty):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert x.search(empty, items).count() == 0
    assert x.search(docs, items.limit(0)).count() == 0
    assert x.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_over_the_tables_matches_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    assert got(x.op13(spark, folder)) == sorted(c.execute(x.OP13_SQL).fetchall(), key=str)
