"""Connected components of an edge table, by hooking to smaller neighbours and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root): pointers to ever smaller nodes followed to their ends, twice as far each time."""
    parents, before = checkpoint(parents), None
    while True:
        total = parents.agg(F.sum(F.col("root").cast("decimal(38,0)")).alias("s")).first()["s"]
        if total == before:
            return parents
        before = total
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        parents = checkpoint(parents.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node that edges reach.

    A round hooks each node to its smallest neighbour if that is smaller, follows the pointers to their roots, and replaces
    edges by edges between roots. Roots with an edge left have a smaller one beside them, so the nodes at least halve each
    round, and a star is one round. Minima are folded before each shuffle, so a node with very many neighbours
    sends and gets one row per task. Loops, repeated edges and an empty table are fine.
    """
    edges = checkpoint(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct())
    labels = None
    while labels is None or edges.limit(1).count():
        smaller = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
        ends = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
        roots = _roots(smaller.unionByName(ends).groupBy("node").agg(F.min("root").alias("root")))
        if labels is None:
            labels = roots.select("node", F.col("root").alias("component"))
        else:
            labels = checkpoint(
                labels.join(roots.select(F.col("node").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            )
        low, high = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("lo", "hi"))
        edges = edges.join(low, "lo").join(high, "hi").select(F.least("lo_root", "hi_root").alias("lo"), F.greatest("lo_root", "hi_root").alias("hi"))
        edges = checkpoint(edges.filter("lo < hi").distinct())
    return labels


def join_components(labels: DataFrame, more: DataFrame) -> DataFrame:
    """labels, (node, component), after the further edges (a, b), whose ends need not be among the nodes."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    between = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    joined = components(between)
    up = joined.select(F.col("node").alias("component"), F.col("component").alias("higher"))
    old = labels.join(up, "component", "left").select("node", F.coalesce("higher", "component").alias("component"))
    return checkpoint(old.unionByName(joined.join(labels.select("node"), "node", "left_anti")))
