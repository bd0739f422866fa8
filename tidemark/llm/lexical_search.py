"""Ranked lexical search: impact-ordered postings, taken score at a time.

Every row of the items is a query over every document. A term's part of a document's score, its impact, depends on nothing but
the two of them, so it is an integer known before any query is read.

1. One scan counts each document's terms and lists how often it holds each term of the queries; that table is staged. From it come
   N, L and each term's df.
2. Each task makes an index of the documents it reads, in shards: a term's postings lie by descending impact, equal impacts together.
   A query goes down from the highest impact over all its terms. What a document can still get is bounded by the sum of the highest
   impacts not yet taken, one per term; once that is below the k-th best sum so far, no unseen document can enter, and only those whose
   sum plus the bound reaches it are candidates. Their scores are then completed from the documents' own lists. The best k of the
   shards before count as well, so later shards stop sooner.
3. Each task gives k rows a query at most, of which the first k by score and id are the result.

A shard holds SHARD documents or POSTINGS postings, whichever comes first (one document more at most), so memory doesn't follow the
input. Queries go in blocks of about PAIRS terms together, as their terms are sent to all tasks; each block scans the documents once.
Term hashes only look terms up: bytes are compared, so a collision changes nothing.

Defined results: null, empty and blank texts have no terms, count for neither N nor L, and are never found; an item without terms
has no rows; items with equal ids (null is one id) are one item with all their terms; repeated documents are documents of their own;
equal scores go by ascending doc_id, null last; empty tables give no rows. Columns beside id and text aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stage
from .token_counts import Lookup
from .words import batch_bytes, text_groups, word_hashes

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 10
PAIRS = 100_000
SHARD, POSTINGS = 1 << 15, 1 << 22
#: How far down the impacts each step goes.
STEP = 0.75

_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))
#: Separators become spaces, A-Z small letters.
_TERMS = np.full(256, 32, dtype=np.uint8)
_TERMS[48:58] = np.arange(48, 58)
_TERMS[97:123] = _TERMS[65:91] = np.arange(97, 123)
_TERMS[128:] = np.arange(128, 256)


class Dictionary:
    """The numbers of the queries' terms, looked up by hash and compared byte by byte."""

    def __init__(self, terms: list[str]):
        raw = np.frombuffer("".join(terms).encode(), dtype=np.uint8)
        ends = np.cumsum([len(t.encode()) for t in terms], dtype=np.int64)
        self.raw, self.starts, self.sizes = raw, ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0)
        spaced = np.frombuffer(" ".join(terms).encode(), dtype=np.uint8)
        self.seed = 0
        while len(np.unique(h := word_hashes(spaced, np.array([0, len(spaced)]), lower=False, seed=self.seed)[2])) < len(terms):
            self.seed += 1
        self.find = Lookup(h, np.arange(len(terms), dtype=np.int64))

    def __call__(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms, and which terms."""
        k = self.find(h, -1)
        at = np.flatnonzero(k >= 0)
        at = at[self.sizes[k[at]] == (e - s)[at]]
        j = 0
        long = at
        same = np.ones(len(s), dtype=bool)
        while len(long := long[self.sizes[k[long]] > j]):
            same[long] &= raw[s[long] + j] == self.raw[self.starts[k[long]] + j]
            j += 1
        at = at[same[at]]
        return at, k[at]


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        count = len(terms.sizes)
        for batch in batches:
            raw, offsets = batch_bytes(batch.column(1))
            for i, j in text_groups(raw, offsets):
                part = _TERMS[raw[offsets[i] : offsets[j]]]
                s, e, h, before = word_hashes(part, offsets[i : j + 1] - offsets[i], lower=False, seed=terms.seed)
                at, k = terms(part, s, e, h)
                doc = np.searchsorted(before, at, side="right") - 1
                pairs, tf = np.unique(doc * count + k, return_counts=True)
                bounds = np.searchsorted(pairs, np.arange(j - i + 1) * count).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(np.diff(before)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array((pairs % count).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(tf.astype(np.int32))),
                    ],
                    ["doc_id", "n", "terms", "tf"],
                )

    return run


def impacts(n: np.ndarray, tf: np.ndarray, w: np.ndarray, docs: int, words: int) -> np.ndarray:
    """Each posting's part of a score, from the length of its document, its frequency and its term's weight."""
    lengths, back = np.unique(n, return_inverse=True)
    m = np.array([100 - 90 + 90 * x * docs // words for x in lengths.tolist()], dtype=np.int64)[back]  # whole numbers of any size
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """An impact-ordered index of some documents, in ascending order of id, and their own lists."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, parts: np.ndarray, count: int):
        self.ids, self.starts, self.terms, self.parts = ids, starts, terms, parts
        order = np.lexsort((-parts, terms))
        self.down = -parts[order]  # ascending
        self.docs = np.repeat(np.arange(len(ids)), np.diff(starts))[order]
        self.ends = np.searchsorted(terms[order], np.arange(count + 1))
        self.sums = np.zeros(len(ids), dtype=np.int64)
        self.mine = np.zeros(count, dtype=bool)
        #: Postings taken, for whoever wants to know how early queries end.
        self.taken = 0

    def best(self, query: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their scores that hold the best k among those with a score of `least` or more."""
        at, end = self.ends[query].copy(), self.ends[query + 1]
        touched: list[np.ndarray] = []
        while True:
            left = np.flatnonzero(at < end)
            bounds = -self.down[at[left]]
            rest = int(bounds.sum())
            if touched:
                seen = np.unique(np.concatenate(touched))
                touched = [seen]
                sums = self.sums[seen]
                floor = max(least, int(np.partition(sums, -k)[-k])) if len(seen) >= k else least
            else:
                seen, floor = np.zeros(0, dtype=np.int64), least
            if rest < floor or not len(left):
                break
            level = int(bounds.max() * STEP)
            for t, b in zip(left.tolist(), bounds.tolist(), strict=True):
                if b >= level:
                    to = at[t] + int(np.searchsorted(self.down[at[t] : end[t]], -level, side="right"))
                    docs = self.docs[at[t] : to]
                    self.sums[docs] -= self.down[at[t] : to]  # a term has one posting a document
                    touched.append(docs)
                    self.taken += len(docs)
                    at[t] = to
        found = seen[self.sums[seen] + rest >= max(floor, 1)]
        self.sums[seen] = 0
        return found, self.complete(found, query)

    def complete(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Whole scores from the documents' own lists."""
        self.mine[query] = True
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[docs] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        sums = np.zeros(len(at) + 1, dtype=np.int64)
        np.cumsum(np.where(self.mine[self.terms[at]], self.parts[at], 0), out=sums[1:])
        self.mine[query] = False
        return sums[ends] - sums[ends - sizes]


_LAST = np.iinfo(np.int64).max


def _searched(shared, k: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        have, docs, postings = [], 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                have.append(part)
                docs += part.num_rows
                postings += len(part.column(2).flatten())
                if docs >= SHARD or postings >= POSTINGS:
                    yield have
                    have, docs, postings = [], 0, 0
        if have:
            yield have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, n_docs, n_words = shared.value
        # the best so far of each query: score, id is null, id, in order
        best = [np.zeros((3, 0), dtype=np.int64) for _ in queries]
        for group in shards(batches):
            table = pa.Table.from_batches(group).combine_chunks()
            ids = table.column("doc_id").combine_chunks()
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            number = ids.fill_null(_LAST).to_numpy()
            table = table.take(pa.array(order := np.lexsort((number, null))))
            lists = table.column("terms").combine_chunks()
            terms, tf = (table.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
            starts = np.zeros(len(order) + 1, dtype=np.int64)
            np.cumsum(lists.value_lengths().to_numpy(), out=starts[1:])
            n = np.repeat(table.column("n").to_numpy(), np.diff(starts))
            shard = Shard(np.arange(len(order)), starts, terms, impacts(n, tf, weights[terms], n_docs, n_words), len(weights))
            for q, query in enumerate(queries):
                have = best[q]
                found, scores = shard.best(query, k, int(have[0, -1]) if have.shape[1] >= k else 1)
                if len(found):
                    rows = np.concatenate((have, [scores, null[order][found], number[order][found]]), axis=1)
                    best[q] = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[:k]]
        for q, rows in enumerate(best):
            if rows.shape[1]:
                ids = pa.array(rows[2], mask=rows[1] == 1)
                yield pa.RecordBatch.from_arrays([pa.array([q] * rows.shape[1], pa.int32()), ids, pa.array(rows[0])], ["q", "doc_id", "score"])

    return run


def term_list(text: str):
    """The terms of a text column, as an array."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = BEST, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's first k documents with a score above 0."""
    spark = docs.sparkSession
    pairs = items.select(F.col(item_id).alias("item_id"), F.explode(term_list(item_text)).alias("term")).distinct()
    pairs = stage(pairs, "queries")
    blocks = max(1, -(-pairs.count() // PAIRS))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in range(blocks):
        rows = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "term").collect()
        if not rows and (out is not None or block < blocks - 1):
            continue
        found = _block(spark, texts, [(r["item_id"], r["term"]) for r in rows], k, pairs.schema["item_id"].dataType)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(spark: SparkSession, texts: DataFrame, pairs: list[tuple], k: int, id_type) -> DataFrame:
    terms = sorted({t for _, t in pairs})
    number = {t: i for i, t in enumerate(terms)}
    queries: dict = {}
    for item, term in pairs:
        queries.setdefault(item, []).append(number[term])
    if not terms:
        return spark.createDataFrame([], "doc_id long, score long").withColumn("item_id", F.lit(None).cast(id_type))
    held = stage(texts.mapInArrow(_postings(spark.sparkContext.broadcast(Dictionary(terms))), "doc_id long, n long, terms array<int>, tf array<int>").filter("n > 0"), "postings")
    size = held.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    df = np.zeros(len(terms), dtype=np.int64)
    for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block
        df[r["t"]] = r["count"]
    weights = np.array([weight(size["docs"], int(x)) for x in df], dtype=np.int64)
    sent = [np.array([t for t in q if df[t] and weights[t]], dtype=np.int64) for q in queries.values()]
    shared = spark.sparkContext.broadcast((sent, weights, size["docs"], size["words"]))
    found = held.filter(F.size("terms") > 0).mapInArrow(_searched(shared, k), "q int, doc_id long, score long")
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(queries)], _id_schema(id_type))
    return found.join(F.broadcast(ids), "q").select("item_id", "doc_id", "score")


def _id_schema(id_type):
    from pyspark.sql.types import IntegerType, StructField, StructType

    return StructType([StructField("q", IntegerType()), StructField("item_id", id_type)])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')"
OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS ts FROM documents), k AS (SELECT r, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
    g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM k), i AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
    f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM k) JOIN (SELECT DISTINCT term FROM i) USING (term) GROUP BY 1, 2),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY term, docs),
    s AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::BIGINT AS score FROM i JOIN f USING (term) JOIN w USING (term) JOIN k USING (r), g GROUP BY 1, 2),
    o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN k USING (r) WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10"""
