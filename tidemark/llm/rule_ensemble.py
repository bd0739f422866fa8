"""Quality classifier as a sparse rule ensemble.

Trees over text statistics are grown on labelled documents; every path from a root to a node is a conjunctive rule. A
lasso logistic regression weighs the rules, most weights become zero, and the remaining ones are compiled into one Spark
column, so scoring is a scan with built-in functions.

The fit reads at most FIT_ROWS labelled documents, those whose hashed ids come first; the statistics of all other
documents are only computed for their scores. The sample's ids are broadcast (8 bytes each).

Defined results: null and blank texts are scored from statistics that are all 0; labels other than 0 and 1, null ids and
ids without a document are left out, a document with several labels gets the largest; with labels of one class, or none, every
score is that class's smoothed share; each row is returned; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, stage
from .quality_rules import MEASUREMENTS, measure

FIT_ROWS = 20_000
TREES, DEPTH, SEED = 24, 3, 7
LASSO = 0.002
ITERATIONS = 60

_words = "greatest(n_words, 1)"
_chars = "greatest(word_chars, 1)"
#: Statistics by name, as SQL over the measurements of the quality rules.
STATISTICS: dict[str, str] = {
    "log_words": "ln(1D + n_words)",
    "word_length": f"word_chars / {_words}",
    "symbol_rate": f"n_symbols / {_words}",
    "repeat_share": f"n_repeat_words / {_words}",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": f"n_upper / {_chars}",
    "exclaim_rate": f"n_exclaims / {_words}",
    "words_per_line": "ln(1D + n_words / greatest(n_lines, 1))",
    "symbols": "ln(1D + n_symbols)",
    "repeats": "ln(1D + n_repeat_words)",
}

#: A condition is (statistic, above, threshold): the statistic is above the threshold, or not.
Condition = tuple[str, bool, float]
Rule = tuple[Condition, ...]


def statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return measure(df, text, keep).select(*keep, *MEASUREMENTS).select(*keep, *(F.expr(e).cast("double").alias(k) for k, e in STATISTICS.items()))


def rules_of(debug: str, names: list[str]) -> list[Rule]:
    """The distinct paths of trees, as their models print them, shortest first."""
    found: set[Rule] = set()
    path: list[tuple[int, Condition]] = []
    for line in debug.splitlines():
        if not (m := re.match(r"( +)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)):
            continue
        depth = len(m[1])
        path = [x for x in path if x[0] < depth] + [(depth, (names[int(m[3])], m[4] == ">", float(m[5])))]
        found.add(_tidy([c for _, c in path]))
    return sorted(found, key=lambda r: (len(r), r))


def _tidy(path: list[Condition]) -> Rule:
    """The same conjunction with one bound per statistic and side."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, above, t in path:
        old = bounds.get((name, above), t)
        bounds[name, above] = max(old, t) if above else min(old, t)
    return tuple(sorted((name, above, t) for (name, above), t in bounds.items()))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, above, t in rule:
        out = out & ((F.col(name) > t) if above else (F.col(name) <= t))
    return out


class Ensemble:
    """An intercept and weighted rules; `score()` is its column over the statistics."""

    def __init__(self, intercept: float, weights: dict[Rule, float]):
        self.intercept, self.weights = intercept, weights

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, w in sorted(self.weights.items()):
            total = total + F.when(holds(rule), float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Ensemble:
    """docs: texts by id; labels: (id, 0 or 1), already without rows that must not be learnt from."""
    sample = (
        labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
        .filter("_id is not null and _y in (0, 1)")
        .groupBy("_id")
        .agg(F.max("_y").cast("double").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(FIT_ROWS)
    )
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text")).join(F.broadcast(sample), "_id").select("text", "y")
    rows = stage(statistics(rows, "text", ("y",)), "statistics")
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(counts) < 2:
        import math

        share = (counts.get(1.0, 0) + 1) / (sum(counts.values()) + 2)
        return Ensemble(math.log(share / (1 - share)), {})
    names = list(STATISTICS)
    data = rows.select("y", array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(data)
    rules = [r for tree in forest.trees for r in rules_of(tree.toDebugString, names)]
    rules = sorted(set(rules), key=lambda r: (len(r), r))
    if not rules:
        return Ensemble(0.0, {})
    flags = array_to_vector(F.array(*(holds(r).cast("double") for r in rules)))
    model = LogisticRegression(labelCol="y", elasticNetParam=1.0, regParam=LASSO, maxIter=ITERATIONS, standardization=True).fit(rows.select("y", flags.alias("features")))
    weights = {r: w for r, w in zip(rules, model.coefficients.toArray().tolist(), strict=True) if w}
    return Ensemble(model.intercept, weights)


def classify(docs: DataFrame, ensemble: Ensemble, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    rows = statistics(docs, text, keep).select(*keep, ensemble.score().alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod("doc_id", 3) != 1)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return classify(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
