"""Near-duplicate documents: one-permutation hashing, optimal densification, bands, star-shaped candidates.

1. One scan gives each text's number of distinct shingles, a 128-bit digest of the set, and 32 band keys from a
   128-bin one-permutation sketch whose empty bins borrow from filled ones by an independent probe sequence per bin.
2. Texts with equal sets form a class; only its smallest doc_id goes on, so copies never meet as pairs.
3. Classes that share a band key form a bucket; each member is paired with the bucket's smallest class only. A pair is a
   link if the full sets, made again from the texts, have 100 * intersection >= 75 * union.
4. In buckets that still hold several components, every class outside the bucket's largest component is compared with all others
   of that bucket, on full sets: blocks of about BLOCK classes meet in pairs, as many tasks as there are pairs of blocks, and a pair
   of blocks sends on only links that join components. Buckets of equal members are one. A bucket whose members link is a few
   stars; only one whose members don't costs its square, in tasks of fixed size, and no list of pairs is ever made.

At a similarity of 0.75 all 32 bands of four bins miss with a probability of 5e-6.

Defined results: null and blank texts have no shingles and stand alone; one to four words are one shingle; rows with
one doc_id are one document with the links of all of them, and each row is returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_hot, stage
from .graph import components, join_components
from .words import batch_bytes, mix, text_groups, word_hashes

SHINGLE = 5
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
SIMILARITY = 75  # per cent
#: Classes per block, and columns of the block's incidence matrix at a time.
BLOCK, COLUMNS = 256, 1 << 13
#: Ids of this many candidate documents at most are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_FACTORS = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)).astype(np.uint64)
_PROBES = 64


def _probe(bins: np.ndarray, block: int) -> np.ndarray:
    """The block-th 64 bins that each of the given empty bins asks."""
    tries = np.arange(block * _PROBES, (block + 1) * _PROBES, dtype=np.uint64)
    return (mix(bins.astype(np.uint64)[:, None] * _FACTORS[7] + tries[None, :] * _FACTORS[8] + _FACTORS[9]) % np.uint64(BINS)).astype(np.int64)


_FIRST = _probe(np.arange(BINS), 0)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    _, _, h, at = word_hashes(raw, offsets)
    whole = np.zeros(0, dtype=np.uint64)
    if len(h) >= SHINGLE:
        n = len(h) - SHINGLE + 1
        whole = h[:n] * _FACTORS[0]
        for k in range(1, SHINGLE):
            whole = whole + h[k : k + n] * _FACTORS[k]
        whole = mix(whole)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i >= SHINGLE:
            u = np.sort(whole[i : j - SHINGLE + 1])
            yield u[np.concatenate(([True], u[1:] != u[:-1]))]
        elif j > i:
            few = h[i:j] * _FACTORS[10 : 10 + j - i]
            yield mix(np.array([few.sum() + np.uint64(j - i)], dtype=np.uint64))
        else:
            yield h[:0]


def sketch(u: np.ndarray) -> np.ndarray:
    """The least hash of each bin (a bin is the top seven bits); empty bins take that of the first filled bin they probe."""
    at = np.append(np.searchsorted(u, _EDGES), len(u))
    filled = at[:-1] < at[1:]
    values = u[np.minimum(at[:-1], len(u) - 1)]
    empty = np.flatnonzero(~filled)
    block = 0
    while len(empty):
        asked = _FIRST[empty] if block == 0 else _probe(empty, block)
        good = filled[asked]
        found = good.any(axis=1)
        values[empty[found]] = values[asked[found, good[found].argmax(axis=1)]]
        empty, block = empty[~found], block + 1
    return values


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = batch_bytes(batch.column(1))
        for i, j in text_groups(raw, offsets):
            sizes, digests, sketches, empty = [], [], [], []
            for u in shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                sizes.append(len(u))
                digests.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                empty.append(not len(u))
                sketches.append(sketch(u) if len(u) else np.zeros(BINS, dtype=np.uint64))
            rows = np.stack(sketches).reshape(-1, BANDS, ROWS)
            keys = rows[:, :, 0] * _FACTORS[11]
            for k in range(1, ROWS):
                keys = keys + rows[:, :, k] * _FACTORS[11 + k]
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64)[None, :] * _FACTORS[15]).view(np.int64)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            lists = pa.ListArray.from_arrays(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), lists],
                ["doc_id", "n_shingles", "d0", "d1", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = batch_bytes(batch.column(1))
        for i, j in text_groups(raw, offsets):
            found = [u.tobytes() for u in shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found, pa.binary())], ["id", "members"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            u, v = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
            both = np.concatenate((u, v))
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= SIMILARITY * (len(both) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])


def sketches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, d0, d1, bands) per row: set size, the set's digest, band keys."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _sketches, "doc_id long, n_shingles long, d0 long, d1 long, bands array<long>"
    )


def _set_table(texts: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    wanted = F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids
    return texts.join(wanted, "id", "left_semi").mapInArrow(_sets, "id long, members binary")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. texts: (id, text). The sets are made anew from the
    texts, and only for documents in pairs; a centre of many pairs is a skewed key of a plain join, which Spark splits."""
    centres, members = (pairs.select(F.col(c).alias("id")).distinct() for c in ("a", "b"))
    counts = pairs.agg(F.countDistinct("a").alias("a"), F.countDistinct("b").alias("b")).first()
    right = _set_table(texts, members, counts["b"]).select(F.col("id").alias("b"), F.col("members").alias("y"))
    left = _set_table(texts, centres, counts["a"]).select(F.col("id").alias("a"), F.col("members").alias("x"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long")


def link(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id (smallest doc_id with an equal set), component_id."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows = stage(sketches(docs, text, doc_id), "sketches")
    total = rows.count()
    classes = stage(rows.filter("n_shingles > 0").groupBy("d0", "d1").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "classes")
    placed = join_hot(rows.filter("n_shingles > 0"), classes, ["d0", "d1"], "n", total)
    member = stage(placed.select("doc_id", "n_shingles", "class_id", F.when(F.col("class_id") == F.col("doc_id"), F.col("bands")).alias("bands")), "members")
    keyed = member.filter("bands is not null").select(F.col("class_id").alias("id"), F.explode("bands").alias("key")).distinct()
    buckets = keyed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    shared = stage(join_hot(keyed, stage(buckets, "centres"), ["key"], "n", BANDS * total).select("key", "a", F.col("id").alias("b")).filter("a <> b"), "buckets")
    pairs = stage(shared.select("a", "b").distinct(), "pairs")
    links = stage(confirm(pairs, texts), "links")
    labels = components(links)
    # a bucket's smallest class has met all its members; what may be left open is between the others, if they are of several components
    open_ = shared.join(labels.withColumnRenamed("node", "b"), "b", "left").select(F.col("key").alias("g"), "b", F.coalesce("component", "b").alias("c"))
    several = open_.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("b").cast("decimal(38,0)")).alias("print"), F.min("b").alias("first"))
    # of buckets with the same members one is enough
    several = several.filter("lo < hi").groupBy("n", "print", "first").agg(F.min("g").alias("g")).select("g", "n")
    open_ = stage(join_hot(open_, stage(several, "several"), ["g"], "n", BANDS * total).select("g", "b", "c"), "open")
    if open_.limit(1).count():
        labels = join_components(labels, stage(compare_blocks(open_, texts), "more_links"))
    known = classes.filter("class_id is not null").groupBy("class_id").agg(F.sum("n").alias("n")).join(labels.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    found = join_hot(member, stage(known, "known"), ["class_id"], "n", total).select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("class_id"), F.col("doc_id").alias("component_id"))
    nameless = member.filter("class_id is null").select("doc_id", "n_shingles", "class_id", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).unionByName(nameless)


def _blocks(table: pa.Table) -> pa.Table:
    """Links between components among one pair of blocks: of loose classes with each other, or with those of the other block."""
    ids, of, loose = (table.column(c).to_numpy() for c in ("id", "c", "loose"))
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("members")]
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[row[i:j], column[i:j] - lo] = 1
        shared += part @ part.T
    near = 100 * shared >= SIMILARITY * (sizes[:, None] + sizes[None, :] - shared)
    near &= (of[:, None] != of[None, :]) & (loose[:, None] | loose[None, :])
    # one link per two components is enough
    x, y = np.nonzero(np.triu(near))
    pairs = np.stack((np.minimum(of[x], of[y]), np.maximum(of[x], of[y])), axis=1)
    _, first = np.unique(pairs, axis=0, return_index=True) if len(x) else (None, np.zeros(0, np.int64))
    return pa.table({"a": pa.array(ids[x[first]], pa.int64()), "b": pa.array(ids[y[first]], pa.int64())})


def compare_blocks(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join components within buckets. open_: (g, b, c), class b of component c in bucket g."""
    of = open_.groupBy("g", "c").agg(F.count("*").alias("n")).groupBy("g").agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("n"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    of = stage(of.select("g", "n", F.col("m.c").alias("main"), blocks(F.col("n") - F.col("m.n")).alias("p"), blocks(F.col("m.n")).alias("q")), "mains")
    rows = join_hot(open_, of, ["g"], "n", open_.count()).withColumn("loose", F.col("c") != F.col("main"))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("b"), F.when(F.col("loose"), F.col("p")).otherwise(F.col("q"))).cast("int"))
    # loose block i meets the loose blocks (lo, hi) and, as (i, -1 - j), each block j of the main component
    others = F.sequence(F.lit(0), F.col("p") - 1)
    meets = F.when(
        F.col("loose"),
        F.concat(
            F.transform(others, lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi"))),
            F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: F.struct(F.col("i").alias("lo"), (-1 - j).alias("hi"))),
        ),
    ).otherwise(F.transform(others, lambda k: F.struct(k.alias("lo"), (-1 - F.col("i")).alias("hi"))))
    ids = stage(rows.select(F.col("b").alias("id"), "g", "c", "loose", F.array_distinct(meets).alias("meets")), "meets")
    wanted = ids.select("id").distinct()
    sets = _set_table(texts, wanted, wanted.count())
    met = sets.join(ids, "id").select("id", "c", "loose", "members", "g", F.explode("meets").alias("m"))
    return met.select("id", "c", "loose", "members", "g", "m.lo", "m.hi").groupBy("g", "lo", "hi").applyInArrow(_blocks, "a long, b long")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; those without a doc_id stay."""
    gone = stage(link(docs, text, doc_id).filter("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, doc_id, "left_anti")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "class_id"
    )
