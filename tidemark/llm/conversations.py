"""Repair of conversation structure: cheapest edits by Dial's bucket queue, then a walk along tight arcs.

A conversation is good when the initials of its roles spell `(s?(ua)+)?`. Its rows can be kept (0), given the role user or assistant
(3) or deleted (4), and an empty row of user or assistant can come in anywhere (3); blank rows and repeats must be deleted, and a
truncated row that stays costs 3 more. Nodes are (rows passed, state of the pattern), and the role that an edit gives follows from the
state, so a path is its string of initials: Delete, Insert, Keep, Rerole, whose order is ASCII's. Distances to the end are
recorded by a queue of as many buckets as the costs allow; from the start, the least initial among the arcs that lose exactly their
cost is taken, which is the least string of the cheapest.

Conversations are dealt by id and read as sorted streams, one in memory at a time. One with more than LARGE rows is cut into
blocks of BLOCK: its rows are numbered by ranges, each block gives the distances between its ends for each pair of states, these
are folded from the last block to the first, each block is walked from every state, and the blocks are chained. A block's summary is a few numbers and
its audits, so such a conversation is spread over tasks too. Only its digest reads all its repaired text in order, as SHA-256
must, as a stream. Large conversations are told to all tasks, HOT_KEYS ids at most: with more rows than LARGE * HOT_KEYS in all, only larger ones count.

Defined results: null conv_id is a conversation of its own; a null turn comes first and counts for no gap; null roles and texts are one space; rows of one
turn go by role and text; a role that is none of the three by its initial, or empty, can't be kept; gaps are null where they don't fit 64 bits; a
conversation without rows has zeros, an empty audit and the digest of nothing; an empty table gives no rows. Further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import HOT_KEYS, join_hot, stage

LARGE, BLOCK = 16_384, 4_096

#: Costs of edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
FINE, BLANK, REPEAT, CUT = range(4)  # faults

# States: nothing yet, after system, after user, after assistant. By state: the next state for s, u, a and any other initial, -1: none.
_NEXT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: The role that an edit gives in a state, and the state then.
_ROLE = ("user", "user", "assistant", "user")
_THEN = (2, 2, 3, 2)
#: What remains to be inserted at the end, by state, and its cost.
_REST = ("", "II", "I", "")
END = tuple(INSERT * len(x) for x in _REST)
_FAR = 1 << 60


def _row_arcs(code: int, fault: int) -> list[list[tuple[str, int, int]]]:
    """By state, the arcs over a row with this initial and fault: (edit, state, cost) in the order of the edits' initials."""
    out = []
    for state in range(4):
        arcs = [("D", state, DELETE)]
        if fault not in (BLANK, REPEAT):
            more = TRUNCATED if fault == CUT else 0
            if _NEXT[state][code] >= 0:
                arcs.append(("K", _NEXT[state][code], more))
            arcs.append(("R", _THEN[state], REROLE + more))
        out.append(arcs)
    return out


_ARCS = [_row_arcs(code, fault) for code in range(4) for fault in range(4)]
#: The same arcs by the state they lead to: (state, cost).
_BACK = [[[(s, c) for s in range(4) for _, t, c in arcs[s] if t == to] for to in range(4)] for arcs in _ARCS]
_INSERTS = [[s for s in range(4) if _THEN[s] == to] for to in range(4)]
_MOST = max(REROLE + TRUNCATED, DELETE, INSERT)


def kind(initial: str, fault: int) -> int:
    return 4 * ("sua".find(initial) if initial and initial in "sua" else 3) + fault


def distances(kinds: list[int], end: tuple[int, ...]) -> list[int]:
    """Dial: the cost from each node, 4 * rows passed + state, to the end, where the states have these distances already."""
    n, base = len(kinds), min(end)
    dist = [_FAR] * (4 * n + 4)
    ends = [x - base for x in end if x < _FAR]
    buckets: list[list[int]] = [[] for _ in range(_MOST + max(ends) + 1)]
    open_, now, size = 0, 0, len(buckets)
    for s, x in enumerate(end):
        if x < _FAR:
            dist[4 * n + s] = x - base
            buckets[(x - base) % size].append(4 * n + s)
            open_ += 1
    done = bytearray(4 * n + 4)
    while open_:
        bucket = buckets[now % size]
        while bucket:
            node = bucket.pop()
            open_ -= 1
            if done[node] or dist[node] != now:
                continue
            done[node] = 1
            passed, state = divmod(node, 4)
            before = [(node - state + s, INSERT) for s in _INSERTS[state]] if passed < n else []
            if passed:
                before += [(node - state - 4 + s, c) for s, c in _BACK[kinds[passed - 1]][state]]
            for other, cost in before:
                if now + cost < dist[other]:
                    dist[other] = now + cost
                    buckets[(now + cost) % size].append(other)
                    open_ += 1
        now += 1
    return [x if x >= _FAR else x + base for x in dist]


def walk(kinds: list[int], dist: list[int], state: int) -> tuple[str, int]:
    """The least audit among the cheapest ways on from a state before the first row, and the state after the last row."""
    out, at = [], 0
    while at < len(kinds):
        here = dist[4 * at + state]
        arcs = _ARCS[kinds[at]][state]
        if here == arcs[0][2] + dist[4 * at + 4 + state]:
            edit, at = "D", at + 1
        elif here == INSERT + dist[4 * at + _THEN[state]]:
            edit, state = "I", _THEN[state]
        else:
            edit, state, _ = next(a for a in arcs[1:] if here == a[2] + dist[4 * at + 4 + a[1]])
            at += 1
        out.append(edit)
    return "".join(out), state


def lines(audit: str, initials: list[str], roles: list[str], texts: list[str], state: int) -> Iterator[tuple[int, str]]:
    """The repaired rows: (rows passed before it, role:text)."""
    at = 0
    for edit in audit:
        if edit == "I":
            yield at, f"{_ROLE[state]}:"
            state = _THEN[state]
            continue
        if edit == "K":
            yield at, f"{roles[at]}:{texts[at]}"
            state = _NEXT[state]["sua".index(initials[at])]
        elif edit == "R":
            yield at, f"{_ROLE[state]}:{texts[at]}"
            state = _THEN[state]
        at += 1


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, as lists that share their first `key` values."""
    rows = (r for batch in batches for i in range(0, batch.num_rows, 1024) for r in zip(*(c.to_pylist() for c in batch.slice(i, 1024).columns), strict=True))
    for _, run in groupby(rows, key=lambda r: r[:key]):
        yield list(run)


def _batches(rows: Iterator[tuple], schema: str, most: int = 2048) -> Iterator[pa.RecordBatch]:
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    have, size = [], 0
    for r in rows:
        have.append(r)
        size += sum(len(x) for x in r if isinstance(x, str)) // 1024
        if len(have) + size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(zip(*have, strict=True), types, strict=True)], list(names))
            have, size = [], 0
    if have:
        yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(zip(*have, strict=True), types, strict=True)], list(names))


def _streamed(df: DataFrame, by: list[str], order: list, run, schema: str) -> DataFrame:
    """run over df's rows as sorted streams that hold all rows of `by`."""
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(lambda batches: _batches(run(batches), schema), schema)


OUT = "key string, gaps long, blank long, repeated long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversations of one block: (key, turn, role, text, initial, fault)."""
    for rows in _runs(batches, 1):
        seen, faults = set(), []
        for _, _, role, text, _, fault in rows:
            same = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            faults.append(REPEAT if same in seen and fault != BLANK else fault)
            seen.add(same)
        initials = [r[4] for r in rows]
        kinds = [kind(i, f) for i, f in zip(initials, faults, strict=True)]
        dist = distances(kinds, END)
        audit, state = walk(kinds, dist, 0)
        audit += _REST[state]
        digest = hashlib.sha256("\n".join(x for _, x in lines(audit, initials, [r[2] for r in rows], [r[3] for r in rows], 0)).encode())
        turns = {r[1] for r in rows if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield rows[0][0], gaps if gaps < 1 << 63 else None, faults.count(BLANK), faults.count(REPEAT), faults.count(CUT), illegal(initials), dist[0], audit, digest.hexdigest()


def _block_summary(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, block, pos, initial, fault) in order: the distances between a block's ends, its first and last initials, what is illegal inside."""
    for rows in _runs(batches, 2):
        initials = [r[3] for r in rows]
        kinds = [kind(r[3], r[4]) for r in rows]
        ends = [distances(kinds, tuple(0 if s == t else _FAR for s in range(4))) for t in range(4)]
        yield *rows[0][:2], [ends[t][s] for s in range(4) for t in range(4)], initials[0], initials[-1], illegal(initials)


def _fold_back(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Summaries from a conversation's last block to its first: the distances that each block ends with, those it starts with, what is illegal up to the next block."""
    key = None
    for rows in (r for run in _runs(batches, 2) for r in run):
        if rows[0] != key:
            key, end, following = rows[0], END, None
        between, first, last, inside = rows[2:]
        start = tuple(min(between[4 * s + t] + end[t] for t in range(4)) for s in range(4))
        yield rows[0], rows[1], list(end), start[0], inside + (following is not None and illegal([last, following]))
        end, following = start, first


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, block, pos, initial, fault, end): a block walked from each state."""
    for rows in _runs(batches, 2):
        kinds, end = [kind(r[3], r[4]) for r in rows], tuple(rows[0][5])
        dist = distances(kinds, end)
        found = [walk(kinds, dist, s) for s in range(4)]
        yield *rows[0][:2], [a for a, _ in found], [s for _, s in found]


def _fold_on(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Blocks in order: the state each is entered with, its audit, and the state it leaves."""
    key = None
    for run in _runs(batches, 2):
        for k, block, audits, states in run:
            if k != key:
                key, state = k, 0
            yield k, block, state, audits[state], states[state]
            state = states[state]


def _joined_audits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, block, audit, leaves) in order."""
    for rows in _runs(batches, 1):
        yield rows[0][0], "".join(r[2] for r in rows) + _REST[rows[-1][3]]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, block, pos, initial, role, text, entry, audit, leaves, last): repaired rows, numbered as the rows they go before or replace."""
    for rows in _runs(batches, 2):
        _, block, pos, _, _, _, entry, audit, leaves, last = rows[0]
        rest = _REST[leaves] if last == block else ""
        n = 0
        for at, line in lines(audit + rest, *([r[k] for r in rows] for k in (3, 4, 5)), entry):
            yield rows[0][0], pos + at, n, line
            n += 1


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    key, digest = None, None
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            for k, line in zip(*(batch.slice(i, 1024).column(c).to_pylist() for c in (0, 3)), strict=True):
                if k != key:
                    if key is not None:
                        yield key, digest.hexdigest()
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
    if key is not None:
        yield key, digest.hexdigest()


def _large(rows: DataFrame, total: int) -> DataFrame:
    """As `_whole`, for conversations of any length. rows: (key, turn, role, text, initial, fault)."""
    placed = ranked(rows, ["key"], [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")], "pos")
    placed = placed.select("*", F.expr(f"(pos - 1) div {BLOCK}").alias("block"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"))
    placed = stage(placed, "placed")
    firsts = stage(placed.groupBy("key", "same").agg(F.min("pos").alias("first"), F.count("*").alias("n")), "firsts")
    again = (F.col("first") < F.col("pos")) & (F.col("fault") != BLANK)
    placed = join_hot(placed, firsts, ["key", "same"], "n", total).withColumn("fault", F.when(again, REPEAT).otherwise(F.col("fault")))
    placed = stage(placed.select("key", "block", "pos", "turn", "initial", "fault", "role", "text"), "faults")
    blocks, light = ["key", "block"], placed.select("key", "block", "pos", "initial", "fault")

    between = _streamed(light, blocks, ["pos"], _block_summary, "key string, block long, between array<long>, first string, last string, inside long")
    back = stage(_streamed(between, ["key"], [F.desc("block")], _fold_back, "key string, block long, end array<long>, start long, illegal long"), "ends")
    walked = _streamed(light.join(back.select("key", "block", "end"), blocks), blocks, ["pos"], _walked, "key string, block long, audits array<string>, states array<int>")
    chosen = stage(_streamed(walked, ["key"], ["block"], _fold_on, "key string, block long, entry int, audit string, leaves int"), "entries")

    audits = _streamed(chosen.select("key", "block", "audit", "leaves"), ["key"], ["block"], _joined_audits, "key string, audit string")
    last = chosen.groupBy("key").agg(F.max("block").alias("last"))
    edited = placed.select("key", "block", "pos", "initial", "role", "text").join(chosen.join(last, "key"), blocks)
    parts = _streamed(edited, blocks, ["pos"], _parts, "key string, pos long, n long, line string")
    digests = _streamed(parts, ["key"], ["pos", "n"], _digests, "key string, repaired_sha256 string")
    turns = placed.groupBy("key", "turn").agg(*(F.count_if(F.col("fault") == f).alias(c) for c, f in (("blank", BLANK), ("repeated", REPEAT), ("truncated", CUT))))
    gaps = F.try_subtract(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1)), F.count("turn"))
    counts = turns.groupBy("key").agg(F.when(F.count("turn") == 0, 0).otherwise(gaps).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "repeated", "truncated")))
    costs = back.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.max(F.when(F.col("block") == 0, F.col("start"))).alias("cost"))
    empty = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return counts.join(costs, "key").join(audits, "key").join(digests, "key", "left").select("key", "gaps", "blank", "repeated", "truncated", "illegal", "cost", "audit", empty)


def _key(c: str):
    return F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c).cast("string"), F.lit("")))


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """rows: (conv_id, turn, role, text). Per conversation of ids (by default of rows): its faults, cost, audit and repaired digest."""
    ids = (rows if ids is None else ids).select("conv_id", _key("conv_id").alias("key")).distinct()
    text = F.coalesce(F.col("text"), F.lit(" "))
    end = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(end == "", BLANK).when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)
    role = F.coalesce(F.col("role"), F.lit(" "))
    rows = rows.select(_key("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.substring(role, 1, 1).alias("initial"), fault.alias("fault"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    large = sizes.filter(F.col("n") > max(LARGE, -(-total // HOT_KEYS))).select("key")
    large = stage(large, "large")
    some = large.limit(1).count() > 0
    whole = rows.join(F.broadcast(large), "key", "left_anti") if some else rows
    out = _streamed(whole, ["key"], [F.asc_nulls_first("turn"), "role", "text"], _whole, OUT)
    if some:
        out = out.unionByName(_large(rows.join(F.broadcast(large), "key"), total))
    numbers = [F.when(F.col("audit").isNull(), F.lit(0)).otherwise(F.col(c)).cast("long").alias({"repeated": "duplicate"}.get(c, c)) for c in ("gaps", "blank", "repeated", "truncated", "illegal", "cost")]
    nothing = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))
    return ids.join(out, "key", "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), nothing.alias("repaired_sha256"))


def damage(rows: DataFrame) -> DataFrame:
    """Faults by crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes out its `.!?`, 3 repeats it, 4 makes its role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    copies = F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_")).drop("_")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damage(rows), rows)
