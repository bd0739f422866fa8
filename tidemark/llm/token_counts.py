"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

A pre-token here is a run of characters other than ASCII white space. The tokenizer's own splits never cross such
space, so a text's count is the sum over its pre-tokens, each tokenized whole by the library (special strings included).

1. One scan gives the distinct pre-tokens with their frequency, by a hash; each is tokenized once, in the table of pre-tokens.
   Should two of them share a hash, which the same job sees, it is done again with another seed: joins on the hash are exact.
2. The FREQUENT most frequent of them go to all tasks (16 bytes each), the others are joined by their hash.
3. A second scan sums the frequent ones per document and lists the rest with their frequencies, which are joined and added.

Defined results: null and blank texts have 0 tokens (a null text 0 bytes too); each row is returned, rows with equal doc_id
and text alike; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stage, stage_observed
from .words import batch_bytes, text_groups, word_hashes

TOKENIZER = "word_bpe_49k.json"
#: How many pre-tokens are broadcast.
FREQUENT = 1_000_000
LIMIT = 2048


def gather(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices of raw as a string array."""
    sizes = ends - starts
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    data = raw[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


class Lookup:
    """Values by 64-bit key, for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def __call__(self, keys: np.ndarray, missing: int) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), missing, dtype=self.values.dtype)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.values.dtype.type(missing))


def _distinct(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = batch_bytes(batch.column(0))
            found = []
            for i, j in text_groups(raw, offsets):
                s, e, h, _ = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=False, seed=seed)
                keys, at, n = np.unique(h, return_index=True, return_counts=True)
                found.append((keys, s[at] + offsets[i], e[at] + offsets[i], n))
            h, s, e, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.uint64)] * 4
            keys, at, back = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(back, weights=n, minlength=len(keys)).astype(np.int64)
            step = 1 << 16  # rows out at once
            for k in range(0, len(keys), step):
                some = slice(k, k + step)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[some].view(np.int64)), gather(raw, s[at[some]].astype(np.int64), e[at[some]].astype(np.int64)), pa.array(total[some])], ["h", "word", "n"]
                )

    return run


def _pieces(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):  # encodings take many times the memory of their words
                batch = whole.slice(k, 1024)
                got = tokenizer.encode_batch_fast(batch.column(1).to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x.ids) for x in got], pa.int32())], ["h", "n", "pieces"])

    return count


def pretokens(docs: DataFrame, text: str, path: str) -> tuple[DataFrame, int]:
    """(h, n, pieces), hash, frequency and piece count of each distinct pre-token; and the seed of the hash."""
    seed = 0
    while True:
        found = docs.select(F.col(text).alias("text")).mapInArrow(_distinct(seed), "h long, word string, n long")
        table = found.groupBy("h").agg(F.min("word").alias("word"), F.max("word").alias("other"), F.sum("n").alias("n"))
        table, seen = stage_observed(table, "pretokens", two=F.max(F.col("word") != F.col("other")))
        if not seen["two"]:
            return stage(table.select("h", "word", "n").mapInArrow(_pieces(path), "h long, n long, pieces int"), "pieces"), seed
        seed += 1


def _documents(frequent, seed: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pieces = frequent.value
        lookup = Lookup(keys, pieces)
        for batch in batches:
            raw, offsets = batch_bytes(batch.column(1))
            for i, j in text_groups(raw, offsets):
                part, places = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                _, _, h, at = word_hashes(part, places, lower=False, seed=seed)
                k = lookup(h, -1)
                rare = np.flatnonzero(k < 0)
                sums = np.zeros(len(k) + 1, dtype=np.int64)
                np.cumsum(np.maximum(k, 0), out=sums[1:])
                doc = np.searchsorted(at, rare, side="right") - 1
                order = np.lexsort((h[rare], doc))
                doc, hr = doc[order], h[rare][order]
                new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (hr[1:] != hr[:-1])))[: len(doc)])
                f = np.diff(np.append(new, len(doc)))
                bounds = np.searchsorted(doc[new], np.arange(j - i + 1)).astype(np.int32)
                view = memoryview(part)
                digests = b"".join(hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.frombuffer(digests, dtype="<i8")),
                        pa.array(np.diff(places)),
                        pa.array(sums[at[1:]] - sums[at[:-1]]),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(hr[new].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(f.astype(np.int32))),
                    ],
                    ["doc_id", "digest", "n_bytes", "known", "h", "f"],
                )

    return count


def count_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str = TOKENIZER, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row. path: the tokenizer's file, by default that of the installed public one."""
    spark = docs.sparkSession
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(tokenizer)
    table, seed = pretokens(docs, text, path)
    top = table.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h", "pieces").toArrow()
    frequent = spark.sparkContext.broadcast((top.column("h").to_numpy().view(np.uint64), top.column("pieces").to_numpy()))
    rows = stage(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
            _documents(frequent, seed), "doc_id long, digest long, n_bytes long, known long, h array<long>, f array<int>"
        ),
        "counted",
    )
    # rows with equal doc_id and text have the same key; their sum is that of all of them
    key = ["digest", "doc"]
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    more = (
        rows.select(*key, F.inline(F.arrays_zip("h", "f")))
        .join(table.select("h", "pieces"), "h")
        .groupBy(*key)
        .agg(F.sum(F.col("f") * F.col("pieces")).alias("more"))
    )
    alike = rows.groupBy(*key, "doc_id", "n_bytes", "known").agg(F.count("*").alias("rows"))
    whole = alike.join(more, key, "left").withColumn("n_tokens", F.col("known") + F.coalesce(F.expr("more div rows"), F.lit(0)))
    return whole.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_")).drop("_")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
