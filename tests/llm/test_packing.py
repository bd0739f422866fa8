import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing as p


def test_pieces_are_the_library_ids(docs, corpus):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(p.TOKENIZER))
    ids = defaultdict(list)
    for i, t, _ in corpus:
        ids[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    cover, sequences = defaultdict(int), defaultdict(list)
    for r in p.pack(docs).collect():
        a = next(x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"])
        assert zlib.crc32(a[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        cover[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert cover == {i: sum(map(len, xs)) for i, xs in ids.items()}
    short = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= p.WINDOW
        short += at < p.WINDOW
    assert short <= 1


def test_ids_by_words_are_those_of_whole_texts():
    path = public_tokenizers.path(p.TOKENIZER)
    whole, encode, rng = Tokenizer.from_file(path), p.encoder(path), random.Random(6)
    texts = ["", " a  b\n\n c", "x'll don't 12 345", "été ñ ß", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "日本   \x1f \x85", "½ ² ", "tab\t\there", "a" * 3000, " ", "  ", "a ", "\n a", "a\n"]
    alphabet = ["a", "B", "é", "1", ".", "'s", " ", " ", "\n", "\t", "\x85", "\xa0", "\u3000", "日", "<|endoftext|>", "-"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for text in texts:
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_scores_are_bm25():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint16) for _ in range(30)]
    df = np.array([7 + sum(t in d for d in docs) for t in range(40)])
    n, mean = 400, 37.5
    index = p.Index(docs, (df, n, mean))
    for seed in range(30):
        want = [
            sum(
                math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (d == t).sum() * (p.K1 + 1) / ((d == t).sum() + p.K1 * (1 - p.B + p.B * len(d) / mean))
                for t in set(docs[seed].tolist()) if t in d
            )
            for d in docs
        ]
        assert np.allclose(index.scores(seed), want, rtol=1e-4)


def test_equal_rows_spread_over_shards(spark):
    rows = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same few words").alias("text"))
    sizes = p.pack(rows).groupBy(F.shiftright("sequence_id", 32)).count().collect()
    assert len(sizes) >= 5 and max(r["count"] for r in sizes) < 2 * p.SHARD


def test_documents_that_share_a_telling_term_meet(spark, monkeypatch):
    monkeypatch.setattr(p, "SHARD", 40)
    monkeypatch.setattr(p, "COMPANY", 10)
    word = ["volcano", "harpsichord", "tadpole", "sundial", "lighthouse", "mulberry"]
    rows = [(k, f"the one about a {word[k % 6]} and then {word[k % 6]} again with more of it") for k in range(240)]
    got = p.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kinds = defaultdict(set)
    for r in got:
        kinds[r["sequence_id"] >> 32].add(r["doc_id"] % 6)
    assert len(kinds) == 6 and all(len(k) == 1 for k in kinds.values())


def test_shards_are_bounded():
    counts = {1: 5000, 2: 3, 3: 1023, 4: 1024, 5: 900, -1: 10}
    found = {t: (first, own) for t, first, own in p.shards(counts)}
    assert found[1][1] == 5 and found[4][1] == 1 and len(set(found[t][0] for t in (2, 3, 5, -1))) >= 1
    assert set(found) == set(counts)


def test_neighbours_share_words():
    a = [np.array(x, dtype=np.uint16) for x in ([1, 2, 3, 4] * 100, [5, 6, 7] * 100, [1, 2, 3, 9] * 90, [5, 6, 8] * 90)]
    first = p.fill(a)[0]
    assert [d for d, _, _ in first][:2] == [0, 2]


def test_empty(empty):
    assert p.pack(empty).count() == 0
