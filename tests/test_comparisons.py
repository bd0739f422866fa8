"""Orders compared by a plain reading of two lists; the order of reasons that deny a document."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.plans import comparisons as c

K = 3


def plainly(left, right):
    both = [r for r in dict.fromkeys(left) if r in right]
    prefix = 0
    while prefix < min(len(left), len(right)) and left[prefix] == right[prefix]:
        prefix += 1
    top = len(set(left[:K]) & set(right[:K]))
    only = [r for r in set(left) if r not in right], [r for r in set(right) if r not in left]
    repeats = len(left) - len(set(left)) + len(right) - len(set(right))
    measures = (len(left), len(right), len(both), len(only[0]), len(only[1]), top, repeats, prefix, top / min(K, max(len(left), len(right))))
    found = [("DUPLICATE_ENTITY", repeats > 0), ("COUNT_MISMATCH", len(left) != len(right)), ("ENTITY_SET_MISMATCH", set(left) != set(right)), ("ORDERING_MISMATCH", set(left) == set(right) and left != right)]
    rows = [(code, None, None, None) for code, holds in found if holds]
    rows += [("MISSING_ENTITY", r, left.index(r) + 1, None) for r in only[0]] + [("UNEXPECTED_ENTITY", r, None, right.index(r) + 1) for r in only[1]]
    rows += [("POSITION_MISMATCH", r, left.index(r) + 1, right.index(r) + 1) for r in both if left.index(r) != right.index(r)]
    return measures, rows


def test_orders_match_a_plain_comparison(spark):
    rng = random.Random(5)
    cases = {k: ([rng.choice("abcdef") for _ in range(rng.randrange(6))], [rng.choice("abcdef") for _ in range(rng.randrange(6))]) for k in range(120)}
    cases |= {200: (["a", "b"], ["a", "b"]), 201: (["a"], []), 202: ([], ["b", "b"]), 203: (["a", "b", "a"], ["a", "b", "b"])}
    cases = {k: v for k, v in cases.items() if v[0] or v[1]}
    sides = [spark.createDataFrame([(k, i + 1, r) for k, v in cases.items() for i, r in enumerate(v[s])], "case long, position int, ref string") for s in (0, 1)]
    measures, mismatches = c.compare_orders(*sides, ["case"], K)
    names = ["n_first", "n_second", "n_both", "only_first", "only_second", "top_overlap", "repeats", "same_prefix", "top_share"]
    assert {r["case"]: tuple(r[n] for n in names) for r in measures.collect()} == {k: plainly(*v)[0] for k, v in cases.items()}
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["case"], r["code"], r["ref"], r["a"], r["b"]) for r in mismatches.collect()), key=key) == sorted(((k, *m) for k, v in cases.items() for m in plainly(*v)[1]), key=key)


def test_empty_orders(spark):
    none = spark.createDataFrame([], "case long, position int, ref string")
    assert [t.count() for t in c.compare_orders(none, none, ["case"], K)] == [0, 0]


def test_first_reason_denies(spark):
    at = datetime(2024, 2, 1)
    good = {"source": 1, "visibility": "PUBLIC", "publication": "PUBLISHED", "moderation": "ELIGIBLE", "deletion": "ACTIVE", "excluded": False, "region_id": 1, "region_ref": "r", "title": "t", "body": "b", "updated_at": at}
    bad = {"source": None, "visibility": "PRIVATE", "publication": None, "moderation": "HELD", "deletion": "DELETED", "excluded": True, "region_ref": None, "body": " \n", "updated_at": at + timedelta(seconds=5, microseconds=1)}
    rows, want, worse = [good], ["eligible"], {}
    for (reason, _), (k, v) in zip(list(c.DENIALS)[::-1][1:], list(bad.items())[::-1], strict=True):  # ever earlier reasons, the later ones still there
        worse[k] = v
        rows.append(good | worse)
        want.append(reason)
    rows += [good | {"updated_at": at + timedelta(seconds=5)}, good | {"updated_at": at - timedelta(days=7)}, good | {"updated_at": at - timedelta(days=7, microseconds=1)}, good | {"region_id": None}, good | {"title": None}]
    want += ["eligible", "eligible", "authority_stale", "region_missing", "content_invalid"]
    schema = "n int, source int, visibility string, publication string, moderation string, deletion string, excluded boolean, region_id long, region_ref string, title string, body string, updated_at timestamp"
    found = c.deny(spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], schema), max_age_days=7)
    assert [r["decision"] for r in found.orderBy("n").collect()] == want
    with pytest.raises(ValueError, match="max_age_days"):
        c.deny(found, max_age_days=31)
