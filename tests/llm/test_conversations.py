import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tidemark.llm import conversations as x

SPACE = "\x20\t\n\x0b\x0c\r"


def cheapest(initials, faults):
    """The least (cost, audit, roles) by comparing whole strings: at most two rows inserted in a place."""
    n = len(initials)
    good = re.compile("(s?(ua)+)?")

    @lru_cache(None)
    def on(at, state, inserted):
        best = []
        if at == n and state in "-a":
            best.append((0, "", ()))
        step = {"-": "su", "s": "u", "u": "a", "a": "u"}[state]
        for c in step:
            if c != "s" and inserted < 2:
                cost, audit, roles = on(at, c, inserted + 1)
                best.append((cost + 3, "I" + audit, (c, *roles)))
        if at < n:
            cost, audit, roles = on(at + 1, state, 0)
            best.append((cost + 4, "D" + audit, roles))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 if faults[at] == "truncated" else 0
                for c in step:
                    cost, audit, roles = on(at + 1, c, 0)
                    if c == initials[at]:
                        best.append((cost + more, "K" + audit, (c, *roles)))
                    if c != "s":
                        best.append((cost + more + 3, "R" + audit, (c, *roles)))
        return min(best, key=lambda b: (b[0], b[1])) if best else (10**9, "", ())

    cost, audit, roles = on(0, "-", 0)
    assert good.fullmatch("".join(roles))
    return cost, audit, roles


def brute(rows, ids):
    out = []
    for conv in ids:
        mine = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv))
        faults, seen = [], set()
        for _, _, role, text in mine:
            end = text.rstrip(SPACE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        cost, audit, roles = cheapest(initials, faults)
        made, at, k = [], 0, 0
        for edit in audit:
            name = {"s": "system", "u": "user", "a": "assistant"}.get(roles[k]) if k < len(roles) else None
            if edit == "I":
                made.append(f"{name}:")
                k += 1
                continue
            if edit == "K":
                made.append(f"{mine[at][2]}:{mine[at][3]}")
                k += 1
            elif edit == "R":
                made.append(f"{name}:{mine[at][3]}")
                k += 1
            at += 1
        turns = {t for there, t, *_ in mine if there}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), wrong, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=str)


def harmed(rows):
    out = []
    for c, t, r, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, text = " " if r is None else r, " " if text is None else text
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(c, t, "user" if k == 4 else r, text)] * (2 if k == 3 else 1)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "conv_id long, turn long, role string, text string, pos long, key string, block int").repartition(3)


def got(df):
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    rows = []
    for conv in range(120):
        size = rng.choice([1, 2, 3, 5, 8, 13])
        for t in range(size):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "usher", ""])
            text = rng.choice(["Yes.", "No", "Well!  \n", "", " \t", "Again?", f"line {rng.random()}.", "cut off,", None, "é…", "“Ja.”"])
            rows.append((conv, rng.choice([t, t, t, None, 2 * t, -t]), role, text))
    rows += [(500, k, ("user", "assistant")[k % 2], f"Turn {k}." if k % 7 else "Same.") for k in range(90)]  # a long one
    rows += [(None, 0, "user", "No id."), (None, None, "assistant", "None either.")]
    rows += [(600, 3, "user", "Twice."), (600, 3, "user", "Twice."), (601, -(1 << 63), "user", "Far."), (601, (1 << 63) - 1, "assistant", "Apart.")]
    return rows


def test_repair_matches_brute_force(spark, talk):
    want = brute(talk, dict.fromkeys(r[0] for r in talk))
    want = [(w[0], None, *w[2:]) if w[0] == 601 else w for w in want]
    assert got(x.repair(table(spark, talk))) == want


def test_long_conversations_in_blocks(spark, talk, monkeypatch):
    want = got(x.repair(table(spark, talk)))
    monkeypatch.setattr(x, "LARGE", 4)
    monkeypatch.setattr(x, "BLOCK", 3)
    assert got(x.repair(table(spark, talk))) == want


def test_damage(spark, talk):
    rows = x.damage(table(spark, talk)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(harmed(talk), key=str)


def test_every_conversation_has_a_row(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = table(spark, [(gone, 0, "user", "Hello.")])
    assert got(x.repair(x.damage(rows), rows)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_query_over_the_table_matches_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(x.op12(spark, folder)) == brute(harmed(rows), dict.fromkeys(r[0] for r in rows))


def test_empty(spark):
    assert x.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
