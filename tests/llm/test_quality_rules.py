import re

from tidemark.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)} if len(words) < 3000 else None
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_measurements_match_brute_force(docs, corpus):
    got = q.ledger(docs).collect()
    assert len(got) == len(corpus)
    texts = dict((i, t) for i, t, _ in corpus)
    for r in got:
        want = brute(texts[r["doc_id"]])
        have = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert have[:4] == want[:4]
        assert want[4] is None or have[4] == want[4]


def test_policies_are_masks(docs):
    rows = {r["doc_id"]: r for r in q.ledger(docs).withColumn("kept", q.passes()).collect()}
    assert rows[0]["kept"] and rows[209]["kept"]
    assert not rows[206]["kept"] and not rows[207]["kept"]
    assert rows[200]["failure_bits"] & q.mask("few_words")


def test_ablations_match_counting(docs):
    rows = q.ledger(docs).cache()
    bits = [r[0] & q.POLICIES["strict-1"] for r in rows.select("failure_bits").collect()]
    for r in q.ablations(rows).collect():
        bit = q.mask(r["rule"])
        assert r["failed"] == sum(bool(b & bit) for b in bits)
        assert r["failed_alone"] == sum(b == bit for b in bits)
        assert r["kept_without"] == sum(not b & ~bit for b in bits)


def test_empty(empty):
    assert q.ledger(empty).count() == 0
