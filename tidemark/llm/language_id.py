"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the runs of SIZES bytes of its words, lower-cased and with a mark at both ends of a word; words are runs of bytes
other than ASCII signs, digits and controls. Each subword has one of BUCKETS vectors by its hash, a text is the mean of its subwords'
vectors, and a linear layer with a softmax gives languages. Vectors and layer are trained together by stochastic gradient descent in
numpy. As nothing lies between them, a trained model folds to one row of class weights per bucket, so a text is scored
by a sum over its subwords, whatever its length.

The fit takes a sample of at most FIT_ROWS labelled texts, whole, dealt evenly to the languages (the CLASSES most frequent of them), those
whose hashed ids come first; tasks count the sample's subwords, so the driver gets BUCKETS counts a text at most. A fifth of the sample isn't
trained on: it gives the softmax its temperature, by the least log loss, and the score below which a prediction is rejected, the
least one with which CERTAIN of the accepted texts are right.

Defined results: a text that is null or has no letter is `und` with a score of 0, and so is every text where nothing was learnt; a null doc_id is never learnt
from; repeated rows are learnt from as often as they are there, and each row is returned; an empty table gives no rows. Columns other than the named ones aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, documents, stage
from .words import batch_bytes, mix

SIZES = (2, 3, 4, 5)
BUCKETS_LOG = 15
BUCKETS = 1 << BUCKETS_LOG
DIM, EPOCHS, BATCH, RATE, SEED = 16, 6, 16, 2.0, 11
FIT_ROWS, CLASSES = 4_000, 512
CERTAIN = 0.99
SEGMENT = 1 << 18
UNKNOWN = "und"

#: Bytes of words; others become the mark.
_MARK = 32
_BYTES = np.full(256, _MARK, dtype=np.uint8)
_BYTES[97:123] = _BYTES[65:91] = np.arange(97, 123)
_BYTES[128:] = np.arange(128, 256)


def _hashed(b: np.ndarray, before: int = 0) -> np.ndarray:
    """The buckets of the subwords in b that end after its first `before` bytes."""
    marks, wide = b == _MARK, b.astype(np.uint64)
    run, inner, out = wide, np.zeros(len(b), dtype=bool), []
    for n in range(2, max(SIZES) + 1):
        m = len(b) - n + 1
        if m < 1:
            break
        run = (run[:m] << np.uint64(8)) | wide[n - 1 :]
        inner = inner[:m] | marks[n - 2 : n - 2 + m] if n > 2 else inner[:m]
        if n in SIZES:
            start = max(0, before - n + 1)
            good = ~(inner if n > 2 else marks[:m] & marks[1:])[start:]
            out.append((mix(run[start:][good] + np.uint64(n << 56)) >> np.uint64(64 - BUCKETS_LOG)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


def subwords(text: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of a text's subwords, in pieces of bounded size. text: its bytes."""
    edge = np.array([_MARK], dtype=np.uint8)
    for lo in range(0, len(text), SEGMENT):
        hi = min(len(text), lo + SEGMENT)
        before = min(lo, max(SIZES))  # subwords that end in the piece before are counted there
        b = _BYTES[text[lo - before : hi]]
        b = b if lo > before else np.concatenate((edge, b))
        yield _hashed(np.concatenate((b, edge)) if hi == len(text) else b, before + (0 < lo <= before))


def counts(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets a text has, and how often."""
    total = None
    for found in subwords(text):
        if total is None and len(text) <= SEGMENT and len(found) < BUCKETS // 8:
            return np.unique(found, return_counts=True)
        total = np.bincount(found, minlength=BUCKETS) + (0 if total is None else total)
    if total is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    """Class weights of each bucket and of nothing; scores are the softmax over `heat`; below `floor` a prediction is rejected."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    floor: float = 0.0

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not len(at):
            return self.bias.copy()
        return (self.weights[at] * n[:, None]).sum(axis=0) / n.sum() + self.bias

    def predict(self, logits: np.ndarray) -> tuple[int, float]:
        p = np.exp((logits - logits.max()) / self.heat)
        best = int(p.argmax())
        return best, float(p[best] / p.sum())


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str]) -> Model:
    """rows: (language, buckets, counts). Plain SGD in small batches with a falling rate; each language weighs the same in all."""
    rng = np.random.default_rng(SEED)
    size = len(languages)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, size)), np.zeros(size)
    share = np.bincount([y for y, _, _ in rows], minlength=size)
    weigh = len(rows) / np.maximum(share, 1) / max(1, (share > 0).sum())
    steps, done = EPOCHS * -(-len(rows) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            for y, at, n in (rows[i] for i in order[k : k + BATCH].tolist()):
                if not len(at):
                    continue
                f = n / n.sum()
                hidden = (vectors[at] * f[:, None]).sum(axis=0)
                z = hidden @ layer + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                p *= rate * min(weigh[y], 10.0)
                back = layer @ p
                layer -= np.outer(hidden, p)
                bias -= 0.01 * p
                vectors[at] -= f[:, None] * back * len(at) ** 0.5  # a mean over many subwords moves each little
    return Model(languages, vectors @ layer, bias)


def calibrate(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """The temperature of the least log loss over texts that weren't trained on, and the floor of CERTAIN."""
    if not rows:
        return model
    logits = np.array([model.logits(at, n) for _, at, n in rows])
    truth = np.array([y for y, _, _ in rows])

    def loss(heat: float) -> float:
        z = logits / heat
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    model.heat = min((float(h) for h in np.geomspace(0.02, 20, 61)), key=loss)
    found = [model.predict(z) for z in logits]
    score, right = np.array([p for _, p in found]), np.array([k for k, _ in found]) == truth
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    last = np.append(score[order][1:] < score[order][:-1], True)  # equal scores are accepted together
    good = np.flatnonzero((share >= CERTAIN) & last)
    model.floor = float(score[order][good[-1]]) if len(good) else 1.0
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = batch_bytes(batch.column(1))
        for i in range(batch.num_rows):
            at, n = counts(raw[offsets[i] : offsets[i + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([at.astype("<i4").tobytes()]), pa.array([n.astype("<i8").tobytes()])], ["lang", "checks", "at", "n"]
            )


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Learns from rows where `learn` holds and language, text and id are there."""
    hashed = F.xxhash64(F.col(doc_id).cast("long"))
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).rlike(r"\p{L}"))
    sizes = rows.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(CLASSES).collect()
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    each = max(1, FIT_ROWS // len(sizes))
    # hashes below a bound of about twice what is wanted, then the first of these
    bounds = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, (2 * each + 64) / r["n"]))))
    rows = rows.select(hashed.alias("h"), F.col(lang).cast("string").alias("lang"), F.lower(text).alias("text")).withColumn("bound", F.try_element_at(bounds, F.col("lang")))
    rows = rows.filter((F.col("h") / F.lit(2.0**64) + 0.5) <= F.col("bound"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    rows = stage(rows.withColumn("k", first).filter(F.col("k") <= each).select("lang", "text", (F.col("k") % 5 == 0).alias("checks"), "h"), "sample")
    found = stage(rows.select("lang", "text", "checks").mapInArrow(_counted, "lang string, checks boolean, at binary, n binary"), "sample_counts")
    languages = sorted(r["lang"] for r in sizes)
    number = {x: i for i, x in enumerate(languages)}
    table = sorted(((number[r["lang"]], r["checks"], bytes(r["at"]), bytes(r["n"])) for r in found.toLocalIterator()), key=lambda r: (r[0], r[1], r[2], r[3]))
    read = lambda checks: [(y, np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(n, "<i8")) for y, c, at, n in table if c == checks]
    return calibrate(train(read(False), languages), read(True))


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            raw, offsets = batch_bytes(batch.column(1))
            letters = batch.column(2).to_pylist()
            names, scores = [], []
            for i, has in enumerate(letters):
                if not has or not model.languages:
                    names.append(None)
                    scores.append(0.0)
                else:
                    k, p = model.predict(model.logits(*counts(raw[offsets[i] : offsets[i + 1]])))
                    names.append(model.languages[k])
                    scores.append(p)
            accepted = [n is not None and p >= model.floor for n, p in zip(names, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "best", "score", "accepted"])

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, best, lang, score, accepted) per row: the likeliest language (null where there is nothing to go by), and `lang`, which is UNKNOWN unless the prediction is accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.lower(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    found = rows.mapInArrow(_predicted(shared), "doc_id long, best string, score double, accepted boolean")
    return found.select("doc_id", "best", F.when(F.col("accepted"), F.col("best")).otherwise(UNKNOWN).alias("lang"), "score", "accepted")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, crc_mod("doc_id", 3) != 1)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"), "score", (~F.col("accepted")).alias("rejected"))
