"""Brown class-based bigram language model.

    P(text) = product over tokens of P(class | class before) * P(token | class)

Tokens are the words of a text in lower case (A-Z), then one end of text, which is also what stands before the first.
1. One scan of the training documents counts all words.
2. Units: the UNITS most frequent words stand for themselves, every other word, unseen ones too, for its last two bytes while
   classes are exchanged.
3. One scan counts all bigrams of units. Exchange clustering of the ANCHORS most frequent words gives every unit its first
   class; then sweeps exchange all units, in parallel, each into the class whose neighbours explain all of its own best,
   until few move. A sweep that doesn't raise the likelihood of the class bigrams is tried again with half of its moves.
4. One scan counts every other word beside the units' classes, and each counted word gets a class of its own in the same way.
5. One scan makes each text's classes; words beyond the WORDS most frequent, which are broadcast, get theirs, and their counts, by a
   join on their hash, and those never counted the class of their ending. Class transitions are counted over all training tokens and smoothed towards
   the class frequencies (SMOOTHING pseudo-counts); emissions are (c + 0.5) / (N_class + 0.5 * (V_class + 1)), whose last share
   is that of every unseen word of the class. So the probabilities of what can follow add up to one.
6. The last scan scores the classes of all documents.

What is broadcast is bounded by WORDS, 65,536 endings, and CLASSES squared. Counts cover every training document.

Defined results: null and blank texts are the end token alone; each row is returned, rows with equal doc_id and text alike;
a null doc_id is in no remainder, so it is not held out and is learnt from; with no training rows all counts are 0 and
every score is that of unknown tokens; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, stage
from .token_counts import Lookup
from .words import batch_bytes, text_groups, word_hashes

UNITS, WORDS = 20_000, 200_000
ANCHORS = 256
CLASSES = 48
SMOOTHING = 4.0
SWEEPS = 12
#: Exchange ends when no more than this share of the units moves; moves are halved at most so often when they don't help.
MOVED, HALVES = 0.01, 3
WIDE = CLASSES + 1
#: In place of the class of a word that isn't broadcast.
RARE = 255
#: A unit for an ending is ENDING + its last two bytes; the end of text is a unit and a class of its own.
ENDING, END = 0, 1 << 16


def _tokens(batch_text: pa.Array):
    """Per group of texts: first and last text, their bytes and places, word hashes, endings, words before each text."""
    raw, offsets = batch_bytes(batch_text)
    for i, j in text_groups(raw, offsets):
        part, places = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, h, at = word_hashes(part, places)
        last = part[e - 1].astype(np.int64) if len(e) else np.zeros(0, np.int64)
        before = np.where(e - s > 1, part[np.maximum(e - 2, 0)], 0).astype(np.int64) if len(e) else last
        lower = lambda b: np.where((b >= 65) & (b <= 90), b + 32, b)
        yield i, j, part, places, h, lower(before) * 256 + lower(last), at


def _with_ends(values: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """values with `end` put after each text's own."""
    return np.insert(values, at[1:], end)


#: Keys that are held before they are summed and sent on, and entries in one row of packed contexts.
HELD = 1 << 18


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of (keys, counts, others ...) per group of texts: distinct keys, their summed counts, and the first of the others."""
    keys, n, *others = (np.concatenate(x) for x in zip(*parts, strict=True))
    distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
    return distinct, np.bincount(back, weights=n, minlength=len(distinct)).astype(np.int64), *(x[at] for x in others)


def _folded(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts (keys, counts, others ...), summed by key in runs of about HELD keys."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= HELD:
            yield _summed(held)
            held, n = [], 0
    if held:
        yield _summed(held)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts():
        for batch in batches:
            for _, _, _, _, h, ending, _ in _tokens(batch.column(0)):
                keys, at, n = np.unique(h, return_index=True, return_counts=True)
                yield keys, n, ending[at].astype(np.int32)

    for keys, n, ending in _folded(parts()):
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ending), pa.array(n)], ["h", "ending", "n"])


def word_counts(training: DataFrame) -> DataFrame:
    """(h, ending, n) of each distinct word."""
    return training.mapInArrow(_count_words, "h long, ending int, n long").groupBy("h", "ending").agg(F.sum("n").alias("n"))


CONTEXTS = "key long, slots binary, n binary"


def _contexts(keys: np.ndarray, slots: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row per distinct key with the slots beside it and their counts (32 bits each)."""
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], (slots[order].astype(np.int32), n[order].astype(np.int32))
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ 1)) if len(keys) else np.zeros(0, np.int64)
    offsets = pa.py_buffer((4 * np.append(starts, len(keys))).astype(np.int32).tobytes())
    lists = [pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(c.tobytes())]) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(keys[starts].astype(np.int64)), *lists], ["key", "slots", "n"])


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a binary column, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].view(np.int32) if data is not None else np.zeros(0, np.int32), np.diff(ends) // 4


def _bigrams(shared):
    """The contexts of units (slot: 2 * neighbour, + 1 if it follows); the end of text stands before each text's first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        unit_of = Lookup(words, np.arange(len(words), dtype=np.int64) + END + 1)

        def parts():
            for batch in batches:
                for _, _, _, _, h, ending, at in _tokens(batch.column(0)):
                    unit = unit_of(h, -1)
                    unit = _with_ends(np.where(unit < 0, ENDING + ending, unit), at, END).astype(np.int64)
                    yield np.unique(np.append(END, unit[:-1]) << 32 | unit, return_counts=True)

        for keys, n in _folded(parts()):
            u, v = keys >> 32, keys & 0xFFFFFFFF
            yield _contexts(np.concatenate((u, v)), np.concatenate((2 * v + 1, 2 * u)), np.concatenate((n, n)))

    return count


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the items of a square matrix of bigram counts, by the exchange algorithm: each item in turn moves to the
    class that raises the class-bigram likelihood most, until a sweep moves nothing. Starts from frequency rank modulo classes."""
    n = len(bigrams)
    of = np.arange(n) % max(1, min(classes, n))
    k = max(1, min(classes, n))
    b = bigrams.astype(float)
    member = np.eye(k)[of]
    joint = member.T @ b @ member
    f = lambda x: x * np.log(np.maximum(x, 1.0))

    def gain(j: np.ndarray) -> np.ndarray:
        return f(j).sum(axis=(-1, -2)) - f(j.sum(axis=-1)).sum(axis=-1) - f(j.sum(axis=-2)).sum(axis=-1)

    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            own = of[w]
            out, into, loop = member.T @ b[w], member.T @ b[:, w], b[w, w]
            out[own] -= loop
            into[own] -= loop
            base = joint.copy()
            base[own, :] -= out
            base[:, own] -= into
            base[own, own] -= loop
            tries = np.repeat(base[None], k, axis=0)
            c = np.arange(k)
            tries[c, c, :] += out[None, :]
            tries[c, :, c] += into[None, :]
            tries[c, c, c] += loop
            best = int(np.argmax(gain(tries)))
            if best != own:
                of[w], joint = best, tries[best]
                member[w] = 0
                member[w, best] = 1
                moved += 1
        if not moved:
            break
    return of


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, slot, n) with equal ones summed; in order of key."""
    key, slot, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((slot, key))
    key, slot, n = key[order], slot[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])))[: len(key)])
    return key[first], slot[first], np.add.reduceat(n, first) if len(first) else n


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts, sorted by key, as few rows of four flat arrays, which every sweep reads: keys, ends of their entries, slots,
    counts. A key's entries lie in one row. What is held is merged, so a key never takes more than its different slots."""
    held, size = [], 0

    def out(key, slot, n):
        starts = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1))
        columns = (key[starts], np.append(starts[1:], len(key)), slot.astype(np.int32), n)
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], ["keys", "ends", "slots", "n"])

    for batch in batches:
        (slot, each), (n, _) = _entries(batch.column(1)), _entries(batch.column(2))
        if not len(slot):
            continue
        held.append((np.repeat(batch.column(0).to_numpy(), each), slot.astype(np.int64), n.astype(np.int64)))
        size += len(slot)
        if size >= HELD:
            key, slot, n = _merged(held)
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield out(key[:cut], slot[:cut], n[:cut])
            held, size = [(key[cut:], slot[cut:], n[cut:])], 0
    if held:
        yield out(*_merged(held))


PACKED = "keys binary, ends binary, slots binary, n binary"


def packed(rows: DataFrame) -> DataFrame:
    """CONTEXTS with the entries of each key together."""
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_packed, PACKED)


def _beside(batches: Iterator[pa.RecordBatch]):
    """Of packed rows: keys, the key of each entry by its place, slots, and counts."""
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            keys, ends, slots, n = (np.frombuffer(x.as_buffer(), dtype=t) for x, t in zip(row, (np.int64, np.int64, np.int32, np.int64), strict=True))
            yield keys, np.repeat(np.arange(len(keys)), np.diff(ends, prepend=0)), slots, n.astype(float)


def _choose(shared):
    """The class of each row from its neighbours (slot: 2 * neighbour, + 1 if it follows): the one with the largest sum of
    n * log P(neighbour's class | class). Neighbours of class -1 say nothing."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, fit = shared.value
        for keys, row, slot, n in _beside(batches):
            c = classes[slot >> 1].astype(np.int64)
            good = c >= 0
            cell = row[good] * (2 * WIDE) + 2 * c[good] + (slot[good] & 1)
            sums = np.bincount(cell, weights=n[good], minlength=len(keys) * 2 * WIDE).reshape(-1, 2 * WIDE) @ fit
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.argmax(sums, axis=1).astype(np.int32))], ["key", "class"])

    return choose


def _joint(shared):
    """Class bigrams, from what follows each unit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = shared.value, np.zeros(WIDE * WIDE)
        for keys, row, slot, n in _beside(batches):
            after = slot & 1 == 1
            own = classes[keys].astype(np.int64)
            total += np.bincount(own[row[after]] * WIDE + classes[slot[after] >> 1], weights=n[after], minlength=WIDE * WIDE)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen].astype(np.int64))], ["cell", "n"])

    return count


def _matrix(cells: DataFrame) -> np.ndarray:
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(WIDE * WIDE)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(WIDE, WIDE)


def _fit(joint: np.ndarray) -> np.ndarray:
    """fit[2 * neighbour's class + (1 if it follows), class]: log P(neighbour's class | class)."""
    after = np.log((joint + 0.1) / (joint.sum(axis=1, keepdims=True) + 0.1 * WIDE))
    before = np.log((joint.T + 0.1) / (joint.sum(axis=0)[:, None] + 0.1 * WIDE))
    fit = np.empty((2 * WIDE, CLASSES))
    fit[0::2], fit[1::2] = before.T[:, :CLASSES], after.T[:, :CLASSES]
    return fit


def _likelihood(joint: np.ndarray) -> float:
    f = lambda x: float((x * np.log(np.maximum(x, 1.0))).sum())
    return f(joint) - f(joint.sum(axis=0)) - f(joint.sum(axis=1))


def _among(size: int):
    """The bigrams (u, v, n) among the `size` most frequent words."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, row, slot, n in _beside(batches):
            u, v = keys[row] - END - 1, (slot >> 1).astype(np.int64) - END - 1
            good = (slot & 1 == 1) & (u >= 0) & (u < size) & (v >= 0) & (v < size)
            yield pa.RecordBatch.from_arrays([pa.array(u[good].astype(np.int32)), pa.array(v[good].astype(np.int32)), pa.array(n[good].astype(np.int64))], ["u", "v", "n"])

    return pick


def cluster(beside: DataFrame, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit, and the class bigrams. beside: the packed contexts of all units."""
    share = beside.sparkSession.sparkContext.broadcast
    size = min(ANCHORS, n_words)
    cells = beside.mapInArrow(_among(size), "u int, v int, n long").toArrow()
    first = np.zeros((size, size))
    first[cells.column("u").to_numpy(), cells.column("v").to_numpy()] = cells.column("n").to_numpy()
    classes = np.full(END + 1 + n_words, -1, dtype=np.int16)
    joint = np.zeros((WIDE, WIDE))
    if size:
        classes[END + 1 : END + 1 + size] = exchange(first, CLASSES)
        np.add.at(joint, (classes[END + 1 : END + 1 + size, None], classes[None, END + 1 : END + 1 + size]), first)

    def chosen(classes: np.ndarray, joint: np.ndarray) -> np.ndarray:
        got = beside.mapInArrow(_choose(share((classes, _fit(joint)))), "key long, class int").toArrow()
        out = np.zeros(len(classes), dtype=np.int16)
        out[got.column("key").to_numpy()] = got.column("class").to_numpy()
        out[END] = CLASSES
        return out

    count = lambda c: _matrix(beside.mapInArrow(_joint(share(c)), "cell int, n long"))
    start = chosen(classes, joint)
    start[END + 1 : END + 1 + size] = classes[END + 1 : END + 1 + size]
    classes, joint = start, count(start)
    while True:
        wanted = chosen(classes, joint)
        moves = np.flatnonzero(wanted != classes)
        if len(moves) <= MOVED * len(classes):
            return classes, joint
        for half in range(HALVES + 1):
            tried = classes.copy()
            some = moves[:: 1 << half]
            tried[some] = wanted[some]
            now = count(tried)
            if _likelihood(now) > _likelihood(joint):
                break
        else:
            return classes, joint
        classes, joint = tried, now


def _rare_contexts(shared):
    """The contexts of words that are no units: slots are classes of units."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lookup = Lookup(m.words, np.arange(len(m.words), dtype=np.int64))
        held, size = [], 0

        def out():
            nonlocal held, size
            key, slot = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            return _contexts(*_merged([(key, slot, np.ones(len(key), dtype=np.int64))]))

        for batch in batches:
            for _, _, _, _, h, ending, at in _tokens(batch.column(0)):
                unit, c = m.classes(h, ending, lookup)
                c = _with_ends(c, at, CLASSES)
                rare = np.flatnonzero(unit < 0)
                place = rare + np.searchsorted(at, rare, side="right") - 1
                before = np.append(CLASSES, c[:-1])[place]
                slot = np.concatenate((2 * before, 2 * c[place + 1] + 1))
                held.append((np.concatenate((h[rare], h[rare])).view(np.int64), slot))
                size += 2 * len(rare)
                if size >= HELD:
                    yield out()
        if size:
            yield out()

    return count


def rare_classes(training: DataFrame, known, joint: np.ndarray) -> DataFrame:
    """(h, class) of each counted word that is no unit."""
    fit = training.sparkSession.sparkContext.broadcast((np.arange(WIDE, dtype=np.int16), _fit(joint)))
    return packed(training.mapInArrow(_rare_contexts(known), CONTEXTS)).mapInArrow(_choose(fit), "key long, class int").withColumnRenamed("key", "h")


class Model:
    """The broadcast part: classes of units, log10 probabilities of transitions and of unknown words, counts of frequent words."""

    def __init__(self, words, counts, unit_class, ending_class):
        self.words, self.counts, self.unit_class, self.ending_class = words, counts, unit_class, ending_class

    def classes(self, h: np.ndarray, ending: np.ndarray, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
        at = lookup(h, -1)
        return at, np.where(at < 0, self.ending_class[ending], self.unit_class[np.maximum(at, 0)] if len(self.unit_class) else 0)


def _sequence(cs: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cs.as_buffer(), dtype=np.uint8).astype(np.int64)


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(WIDE * WIDE, dtype=np.int64)
    for batch in batches:
        for cs in batch.column(0):
            c = _sequence(cs)
            total += np.bincount(np.append(CLASSES, c[:-1]) * WIDE + c, minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["cell", "n"])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the classes of words that aren't broadcast into their texts' classes."""
    for batch in batches:
        out = []
        for cs, of, h, own in zip(*(batch.column(c) for c in ("cs", "of", "h", "own")), strict=True):
            c = np.frombuffer(cs.as_buffer(), dtype=np.uint8).copy()
            if own.is_valid and len(own.values):
                keys, classes = own.values.field("h").to_numpy(), own.values.field("class").to_numpy()
                order = np.argsort(keys)
                each = classes[order][np.searchsorted(keys[order], h.values.to_numpy())]
                c[c == RARE] = each[np.frombuffer(of.as_buffer(), dtype=np.int32)]
            out.append(c.tobytes())
        keep = [n for n in batch.schema.names if n not in ("cs", "of", "h", "own")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(out, pa.binary())], [*keep, "cs"])


def _paths(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, emit = shared.value
        for batch in batches:
            paths = []
            for cs in batch.column("cs"):
                c = _sequence(cs)
                paths.append(float((step[np.append(CLASSES, c[:-1]), c] - emit[c]).sum()))
            keep = [n for n in batch.schema.names if n != "cs"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(paths, pa.float64())], [*keep, "path"])

    return run


def _score(shared):
    """Per text what broadcast data give: its classes (RARE: another word), and the other words with frequencies and ending classes."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, end_log = shared.value
        lookup = Lookup(m.words, np.arange(len(m.words), dtype=np.int64))
        logs = np.log10(m.counts + 0.5)
        for batch in batches:
            for i, j, part, places, h, ending, at in _tokens(batch.column(1)):
                unit, c = m.classes(h, ending, lookup)
                rare = np.flatnonzero(unit < 0)
                own = np.zeros(len(h) + 1)
                np.cumsum(np.where(unit < 0, 0.0, logs[np.maximum(unit, 0)] if len(logs) else 0.0), out=own[1:])
                seen = np.zeros(len(h) + 1, dtype=np.int64)
                np.cumsum(unit >= 0, out=seen[1:])
                cs = _with_ends(np.where(unit < 0, RARE, c), at, CLASSES).astype(np.uint8)
                with_end = at + np.arange(len(at))
                doc = np.searchsorted(at, rare, side="right") - 1
                order = np.lexsort((h[rare], doc))
                doc, hr = doc[order], h[rare][order]
                new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (hr[1:] != hr[:-1])))[: len(doc)])
                f = np.diff(np.append(new, len(doc)))
                alike = np.zeros(len(doc), dtype=np.int64)
                alike[new] = 1
                of = np.empty(len(doc), dtype=np.int64)
                of[order] = np.cumsum(alike) - 1
                bounds = np.searchsorted(doc[new], np.arange(j - i + 1)).astype(np.int32)
                ends = np.concatenate(([0], with_end[1:]))
                nth = np.searchsorted(rare, at)  # the rare words before each text
                view = memoryview(part)
                digests = b"".join(hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.frombuffer(digests, dtype="<i8")),
                        pa.array(np.diff(at) + 1),
                        pa.array(seen[at[1:]] - seen[at[:-1]]),
                        pa.array(own[at[1:]] - own[at[:-1]] + end_log),
                        pa.array([cs[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()),
                        pa.array([(of[nth[k] : nth[k + 1]] - bounds[k]).astype(np.int32).tobytes() for k in range(j - i)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(hr[new].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(f.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(c[rare][order][new].astype(np.int32))),
                        batch.column(2).slice(i, j - i),
                    ],
                    ["doc_id", "digest", "n_tokens", "known", "emitted", "cs", "of", "h", "f", "e", "out"],
                )

    return score


def score(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row; learns from the rows where held_out is false.

    base_score is the unigram model with half-counts over the same counts.
    """
    spark = docs.sparkSession
    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("out"))
    training = wanted.filter("not out").select("text")
    counts = stage(word_counts(training), "word_counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_docs = training.count()
    n_all, v_all = totals["n"] + n_docs, totals["v"] + (1 if n_docs else 0)

    top = counts.orderBy(F.desc("n"), "h").limit(UNITS).toArrow()
    words, n_words = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    frequent = spark.sparkContext.broadcast(words)
    beside = stage(packed(training.mapInArrow(_bigrams(frequent), CONTEXTS)), "beside")
    classes, joint = cluster(beside, len(words))
    model = Model(words, n_words, classes[END + 1 :].astype(np.int64), classes[:END].astype(np.int64))
    known = spark.sparkContext.broadcast(model)
    rare = stage(rare_classes(training, known, joint).join(counts.select("h", "n"), "h"), "rare")
    next_ = rare.orderBy(F.desc("n"), "h").limit(max(0, WORDS - UNITS)).toArrow()
    all_words, all_counts, all_classes = (
        np.concatenate((have, more)) for have, more in zip(
            (words, n_words, model.unit_class),
            (next_.column("h").to_numpy().view(np.uint64), next_.column("n").to_numpy(), next_.column("class").to_numpy().astype(np.int64)), strict=True,
        )
    )
    ready = spark.sparkContext.broadcast((Model(all_words, all_counts, all_classes, model.ending_class), float(np.log10(n_docs + 0.5))))

    rows = stage(
        wanted.select("doc_id", "text", "out").mapInArrow(
            _score(ready), "doc_id long, digest long, n_tokens long, known long, emitted double, cs binary, of binary, h array<long>, f array<int>, e array<int>, out boolean"
        ),
        "scored",
    ).withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    key = ["digest", "doc"]
    more = (
        rows.select(*key, F.inline(F.arrays_zip("h", "f", "e")))
        .join(rare, "h", "left")
        .groupBy(*key)
        .agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("f")).otherwise(0)).alias("known_more"),
            F.sum(F.round(F.col("f") * F.log10(F.coalesce("n", F.lit(0)) + 0.5), 9).cast("decimal(28,9)")).cast("double").alias("emitted_more"),
            F.collect_set(F.struct("h", F.coalesce("class", "e").alias("class"))).alias("own"),
        )
    )
    columns = "doc_id long, digest long, doc long, out boolean, n_tokens long, known long, emitted double, known_more long, emitted_more double"
    whole = rows.join(more, key, "left").select(*(c.split()[0] for c in columns.split(", ")), "cs", "of", "h", "own")
    whole = stage(whole.mapInArrow(_resolve, columns + ", cs binary"), "classes")

    moves = _matrix(whole.filter("not out").select("cs").mapInArrow(_transitions, "cell int, n long"))
    types = np.zeros(WIDE)
    types += np.bincount(model.unit_class, minlength=WIDE)
    for r in rare.groupBy("class").count().collect():
        types[r["class"]] += r["count"]
    into = moves.sum(axis=0)
    prior = (into + 0.5) / (into.sum() + 0.5 * WIDE)
    step = np.log10((moves + SMOOTHING * prior[None, :]) / (moves.sum(axis=1, keepdims=True) + SMOOTHING))
    emit = np.log10(into + 0.5 * (types + 1))
    emit[CLASSES] = np.log10(into[CLASSES] + 0.5)  # the end's class has the end alone, and no unknown words
    # equal texts have equal sums but for the last bits, which depend on what came before them in a batch
    whole = (
        whole.mapInArrow(_paths(spark.sparkContext.broadcast((step, emit))), columns + ", path double")
        .groupBy(*key, "doc_id", "n_tokens", "known", "known_more", "emitted_more")
        .agg(F.count("*").alias("rows"), F.max("emitted").alias("emitted"), F.max("path").alias("path"))
    )
    emitted = F.col("emitted") + F.coalesce(F.col("emitted_more") / F.col("rows"), F.lit(0.0))
    end_known = 1 if n_docs else 0
    return whole.select(
        "doc_id", "n_tokens",
        (F.col("known") + F.lit(end_known) + F.coalesce(F.expr("known_more div rows"), F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (emitted - F.col("n_tokens") * F.lit(float(np.log10(n_all + 0.5 * (v_all + 1))))).alias("base_score"),
        (emitted + F.col("path")).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_"),
    ).drop("_")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 1
    scored = score(documents(spark, sf_dir), held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
