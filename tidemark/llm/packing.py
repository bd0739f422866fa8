"""Packing documents into token sequences by lexical retrieval.

A document's ids are its text's tokens and then id 0. Whole windows of a document are sequences of their own. What is left
of each document, less than a window, is its remainder. Document frequencies, their number and mean length are counted over the
remainders of the whole corpus. A remainder goes to the shard of its rarest term that at least COMPANY remainders have, so that
those that share telling terms meet wherever they are; a term with many remainders has several shards, dealt by a hash, and terms
with few share one. Each shard, of about SHARD remainders, builds an inverted index of BM25 weights. Its longest unused remainder
seeds a window, the index returns the unused neighbours by score, and they fill the window in that order: those that fit whole
first, then the best one that is left is cut at the window's end and its rest stays in the shard. So every sequence but the last
of a shard is full. Neighbours are looked for within a shard: two remainders whose telling terms differ don't meet.

Shards grow in number with the input, never in size: rows are dealt by a hash that takes in their place, so equal rows spread too.
What is broadcast or comes to the driver has a row per token of the vocabulary at most.

Defined results: null and empty texts are the id 0 alone; equal rows are documents of their own; a null doc_id stays
null; ties of scores take the smaller doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, stage

WINDOW = 1024
SHARD, COMPANY = 1024, 128
K1, B = 1.2, 0.75
TOKENIZER = "byte_bpe_50k.json"
#: Words whose ids a worker remembers.
REMEMBERED = 1_000_000
#: White space that the tokenizer's pattern may join to a following space, so that a space doesn't begin a new word.
_SPACES = re.compile(r"\s ")
#: Latin letters, then ASCII signs, then perhaps a line end and the same again: the pattern's cuts are between these.
_LETTERS, _SIGNS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", r"[!-/:-@\[-`{-~]*"
_PLAIN = re.compile(rf"({_LETTERS})({_SIGNS})(?:\n({_LETTERS})({_SIGNS}))?")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """The library's ids of texts. A byte-level tokenizer's pattern begins a new word at each single space, so a text's ids are those of
    its words, each with its space, one after another; the ids of words seen before are remembered. In a plain word (see _PLAIN) the
    pattern's pieces are the letters, the signs behind them and the line's end; the library's model gives the ids of each, remembered
    too. Other words go through the library whole, and so do texts with other white space and all texts of other kinds of tokenizers."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        splits, model = kind["pre_tokenizer"] or {}, library.model
        level = splits.get("type") == "ByteLevel" and splits["use_regex"] and not splits["add_prefix_space"] and kind["model"].get("type", "BPE") == "BPE"
        self.by_word = bool(level and not kind["normalizer"] and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in kind["added_tokens"]))
        # a plain word has no sign before a letter, so it holds no added token that has
        within = "|".join(re.escape(t["content"]) for t in kind["added_tokens"] if not re.search(r"[!-/:-@\[-`{-~][A-Za-z]", t["content"]))
        special = re.compile(within).search if within else None
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        form = {c: level.pre_tokenize_str(chr(c))[0][0] for c in (*range(0x80), *range(0xC0, 0x250))} if self.by_word else {}
        space, plain, tokenize, encode = form.get(32, ""), _PLAIN.fullmatch, model.tokenize, library.encode

        class Pieces(dict):
            """Ids of the pattern's pieces that have no space before them."""

            def __missing__(self, piece: str) -> bytes:
                found = self[piece] = array("I", [t.id for t in tokenize(piece.translate(form))]).tobytes()
                return found

        pieces = self.pieces = Pieces({"": b""})

        class Ids(dict):
            """Ids of words with the space before them."""

            def __missing__(self, word: str) -> bytes:
                cut = plain(word)
                if cut is None or (special and special(word)):
                    found = array("I", encode(" " + word, add_special_tokens=False).ids).tobytes()
                else:
                    stem, signs, more, end = cut.groups()
                    if more:
                        found = self[stem] + pieces[signs] + pieces["\n"] + pieces[more] + pieces[end]
                    elif signs:
                        found = self[stem] + pieces[signs]
                    else:
                        found = array("I", [t.id for t in tokenize(space + (word if word.isascii() else word.translate(form)))]).tobytes()
                self[word] = found
                return found

        def first(word: str) -> bytes:
            """Ids of a word without a space before it."""
            cut = plain(word)
            if cut is None or (special and special(word)):
                return array("I", encode(word, add_special_tokens=False).ids).tobytes()
            stem, signs, more, end = cut.groups()
            return pieces[stem] + pieces[signs] + (pieces["\n"] + pieces[more] + pieces[end] if more else b"")

        self.library, self.ids, self.first = library, Ids(), first
        self.width = np.dtype(np.uint16 if library.get_vocab_size() <= 1 << 16 else np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if not self.by_word or _SPACES.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        for known in (self.ids, self.pieces):
            if len(known) > REMEMBERED:
                known.clear()
        first, *words = text.split(" ")
        return np.frombuffer(self.first(first) + b"".join(map(self.ids.__getitem__, words)), dtype=np.uint32)


@lru_cache
def encoder(path: str) -> Encoder:
    """One for each worker."""
    return Encoder(path)


def _tokenise(path: str):
    def run(batches):
        encode = encoder(path)
        for batch in batches:
            total, crcs, rest = [], [], []
            for text in batch.column(1):
                ids = np.append(encode(text.as_py() or ""), np.uint32(0))
                whole = len(ids) // WINDOW
                total.append(len(ids))
                crcs.append([zlib.crc32(ids[k * WINDOW : (k + 1) * WINDOW].tobytes()) for k in range(whole)])
                rest.append(ids[whole * WINDOW :].astype(encode.width).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.binary())], ["doc_id", "doc_tokens", "crcs", "rest"]
            )

    return run


def _terms(rests: pa.Array, width: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term) of the distinct terms of each row, in order; and the rows' sizes in tokens."""
    parts = [np.frombuffer(rest.as_buffer(), dtype=width) for rest in rests]
    sizes = np.array([len(x) for x in parts], dtype=np.int64)
    if not sizes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sizes
    keys = np.concatenate(parts).astype(np.int64)
    keys += np.repeat(np.arange(len(parts), dtype=np.int64), sizes) << 32
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return keys >> 32, keys & 0xFFFFFFFF, sizes


def _frequencies(width: np.dtype):
    """(term, docs, tokens, remainders): per batch, in how many remainders each term is; the totals lie at term -1."""

    def run(batches):
        for batch in batches:
            _, terms, sizes = _terms(batch.column(0), width)
            df = np.bincount(terms, minlength=1)
            seen = np.flatnonzero(df)
            empty = np.zeros(len(seen), dtype=np.int64)
            columns = (np.append(seen, -1), np.append(df[seen], 0), np.append(empty, sizes.sum()), np.append(empty, np.count_nonzero(sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["term", "docs", "tokens", "remainders"])

    return run


def _routed(shared, width: np.dtype):
    """Adds the term that a remainder is dealt by: the rarest with COMPANY, else the most frequent; -1 without a remainder."""

    def run(batches):
        df, _, _ = shared.value
        for batch in batches:
            rows, terms, sizes = _terms(batch.column("rest"), width)
            n = df[terms]
            # frequent enough ones first, from the rarest; then the others, from the most frequent; of equals the smallest term
            rank = np.where(n >= COMPANY, n, np.iinfo(np.int64).max - n)
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else rows
            routes = np.full(len(sizes), -1, dtype=np.int64)
            if len(rows):
                least = np.minimum.reduceat(rank, first)
                best = np.flatnonzero(rank == np.repeat(least, np.diff(np.append(first, len(rows)))))
                best = best[np.append(True, rows[best][1:] != rows[best][:-1])]
                routes[rows[best]] = terms[best]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(routes)], [*batch.schema.names, "term"])

    return run


def shards(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(term, first shard, shards): large terms have several of their own, small ones share."""
    out, shard, held = [], 0, 0
    for term, n in sorted(counts.items()):
        if n >= SHARD:
            own = -(-n // SHARD)
            out.append((term, shard, own))
            shard += own
    for term, n in sorted(counts.items()):
        if n < SHARD:
            out.append((term, shard, 1))
            held += n
            if held >= SHARD:
                shard, held = shard + 1, 0
    return out


class Index:
    """BM25 weights of a shard's remainders as postings by term. corpus: document frequencies by term, remainders, and their mean length."""

    def __init__(self, remainders: list[np.ndarray], corpus: tuple[np.ndarray, int, float] | None = None):
        self.n = len(remainders)
        lengths = np.array([len(x) for x in remainders], dtype=np.int64)
        keys = np.concatenate(remainders).astype(np.int64) if self.n else np.zeros(0, np.int64)
        keys += np.repeat(np.arange(self.n, dtype=np.int64), lengths) << 32
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
        tf = np.diff(np.append(first, len(keys))).astype(float)
        doc, term = keys[first] >> 32, keys[first] & 0xFFFFFFFF
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        self.names, back, df = np.unique(term, return_inverse=True, return_counts=True)
        self.first, self.df = np.cumsum(df) - df, df
        dfs, n, mean = (df, self.n, lengths.mean() if self.n else 1.0) if corpus is None else (corpus[0][self.names], *corpus[1:])
        idf = np.log(1 + (n - dfs + 0.5) / (dfs + 0.5))
        norm = K1 * (1 - B + B * lengths / max(mean, 1.0))
        self.weight = (np.repeat(idf, df) * tf[order] * (K1 + 1) / (tf[order] + norm[self.doc])).astype(np.float32).astype(float)  # as bincount takes them
        self.of = np.split(back, np.cumsum(np.bincount(doc, minlength=self.n))[:-1]) if self.n else []

    def scores(self, seed: int) -> np.ndarray:
        at, df = self.first[self.of[seed]], self.df[self.of[seed]]
        ends = np.cumsum(df)
        places = np.repeat(at - ends + df, df) + np.arange(ends[-1])
        return np.bincount(self.doc[places], weights=self.weight[places], minlength=self.n)


def fill(remainders: list[np.ndarray], corpus: tuple[np.ndarray, int, float] | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start in its remainder, length)."""
    index = Index(remainders, corpus)
    start = np.zeros(index.n, dtype=np.int64)
    left = np.array([len(x) for x in remainders], dtype=np.int64)
    found = []
    while len(left) and (seed := int(left.argmax())) >= 0 and left[seed] > 0:
        pieces = [(seed, int(start[seed]), int(left[seed]))]
        room = WINDOW - int(left[seed])
        left[seed] = 0
        if room and left.any():
            scores = index.scores(seed)
            while room:
                unused = left > 0
                fits = unused & (left <= room)
                some = np.flatnonzero(fits if fits.any() else unused)
                if not len(some):
                    break
                d = int(some[scores[some].argmax()])  # the first of equals
                take = min(room, int(left[d]))
                pieces.append((d, int(start[d]), take))
                start[d] += take
                left[d] -= take
                room -= take
        found.append(pieces)
    return found


def _pack(shared, width: np.dtype):
    def run(table: pa.Table) -> pa.Table:
        """The pieces of one shard."""
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "rest", "crcs", "shard")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
        out, sequence = [], (rows[0][4] << 32) if rows else 0
        for doc_id, total, _, crcs, _ in rows:
            for k, crc in enumerate(crcs):
                out.append((doc_id, k * WINDOW, WINDOW, crc, total, sequence, 0))
                sequence += 1
        some = [r for r in rows if r[2]]
        remainders = [np.frombuffer(r[2], dtype=width) for r in some]
        for pieces in fill(remainders, shared.value):
            offset = 0
            for d, start, length in pieces:
                ids = remainders[d][start : start + length].astype(np.uint32)
                doc_id, total, _, crcs, _ = some[d]
                out.append((doc_id, len(crcs) * WINDOW + start, length, zlib.crc32(ids.tobytes()), total, sequence, offset))
                offset += length
            sequence += 1
        names = [x.split()[0] for x in PIECES.split(", ")]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(names, columns, strict=True)})

    return run


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row per piece: see PIECES. path: the tokenizer's file, by default that of the installed public one."""
    spark = docs.sparkSession
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    width = encoder(path).width
    columns = "doc_id long, doc_tokens long, crcs array<long>, rest binary"
    rows = stage(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_tokenise(path), columns), "remainders")
    sums = rows.select("rest").mapInArrow(_frequencies(width), "term long, docs long, tokens long, remainders long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("docs", "tokens", "remainders")))
    table = {c: v.to_numpy() for c, v in zip(("term", "docs", "tokens", "remainders"), sums.toArrow().columns, strict=True)}
    df = np.zeros(max(1, int(table["term"].max(initial=0)) + 1), dtype=np.int64)
    terms = table["term"] >= 0
    df[table["term"][terms]] = table["docs"][terms]
    n = int(table["remainders"].sum())
    shared = spark.sparkContext.broadcast((df, n, float(table["tokens"].sum()) / max(1, n)))
    # written, as it is read twice: for the counts by its last column alone, and to deal the rows
    routed = stage(rows.mapInArrow(_routed(shared, width), columns + ", term long"), "routed")
    counts = {r["term"]: r["count"] for r in routed.groupBy("term").count().collect()}  # a row per token of the vocabulary at most
    places = spark.createDataFrame(shards(counts), "term long, first long, own long")
    dealt = routed.withColumn("place", F.xxhash64("doc_id", "rest", F.monotonically_increasing_id())).join(F.broadcast(places), "term")
    return dealt.select("doc_id", "doc_tokens", "crcs", "rest", (F.col("first") + F.pmod("place", "own")).alias("shard")).groupBy("shard").applyInArrow(_pack(shared, width), PIECES)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
