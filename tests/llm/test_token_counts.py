import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import token_counts as t


def test_counts_match_the_library(docs, corpus):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(t.TOKENIZER))
    want = sorted((i is None, i or 0, len((x or "").encode()), len(tokenizer.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in corpus)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in t.count_tokens(docs).collect())
    assert got == want


def test_rare_pretokens_are_joined(docs, corpus, monkeypatch):
    want = sorted(map(tuple, t.count_tokens(docs).collect()), key=str)
    monkeypatch.setattr(t, "FREQUENT", 5)
    assert sorted(map(tuple, t.count_tokens(docs).collect()), key=str) == want


def test_a_collision_takes_the_next_seed(docs, monkeypatch):
    want = sorted(map(tuple, t.count_tokens(docs).collect()), key=str)
    real, seeds = t._distinct, []

    def first_collides(seed):
        seeds.append(seed)

        def run(batches):
            for batch in real(seed)(batches):
                yield batch if seed else t.pa.RecordBatch.from_arrays([t.pa.array([5] * batch.num_rows, t.pa.int64()), *batch.columns[1:]], batch.schema.names)

        return run

    monkeypatch.setattr(t, "_distinct", first_collides)
    assert sorted(map(tuple, t.count_tokens(docs).collect()), key=str) == want
    assert seeds == [0, 1]


def test_empty(empty):
    assert t.count_tokens(empty).count() == 0
