"""Connected components of an edge table, and of rows that share identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .keyed import join_counted


def _least_neighbour(edges: DataFrame) -> tuple[DataFrame, int]:
    """Each node with the least node among itself and its neighbours, and with its degree; edges go both ways."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"), F.count("*").alias("n")), "least")
    return least, least.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); a component's name is its least node.

    Stars, large and small by turns: every node's larger neighbours move to its least neighbour, then every node's smaller neighbours
    do. Edges don't increase, and the rounds are about the square of the logarithm of the nodes. Only minima are aggregated,
    folded before the shuffle, and a hub's edges meet its minimum by a broadcast, so no node's neighbours are gathered. Each round is written in the shared folder."""
    nodes = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).filter("a is not null").distinct()
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    before = None
    while True:
        least, total = _least_neighbour(edges)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met = join_counted(both, least, ["a"], "n", total)
        # a node's larger neighbours, to its least one
        large = stage(met.filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct(), "large")
        small = large.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = stage(small, "small")
        total = small.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        met = join_counted(large.select(F.col("b").alias("node"), "a"), small, ["node"], "n", total)
        # a node's smaller neighbours, and the node itself, to its least one
        moved = met.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small.select(F.col("m").alias("a"), F.col("node").alias("b")))
        edges = stage(moved.filter("a < b").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    # stars: each node but the centres is in one edge
    return nodes.join(edges.select(F.col("b").alias("a"), F.col("a").alias("component")), "a", "left").select(F.col("a").alias("node"), F.coalesce("component", "a").alias("component"))


def alias_components(rows: DataFrame, identities: list[str], name: str = "component") -> DataFrame:
    """rows with the component they are in, where rows that share a value of any of the identities are together. Rows without any are left out."""
    tag = lambda i, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(c).cast("string")))
    marked = rows.withColumn("_first", F.coalesce(*(tag(i, c) for i, c in enumerate(identities))))
    pairs = [marked.select(F.col("_first").alias("a"), tag(i, c).alias("b")).filter("a is not null and b is not null").distinct() for i, c in enumerate(identities)]
    found = components(reduce(DataFrame.unionByName, pairs))
    sizes = stage(marked.groupBy(F.col("_first").alias("node")).agg(F.count("*").alias("_rows")).join(found, "node").select(F.col("node").alias("_first"), F.col("component").alias(name), "_rows"), "aliases")
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first()["n"]
    return join_counted(marked, sizes, ["_first"], "_rows", total).select(*rows.columns, name)
