"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r, as near to 1 as the targets allow: the sum of r * ln(r) - r + 1 over all documents is least,
subject to one token constraint per source, sum(r * size) = target, and r <= LIMIT. The solution is an exponential tilt,
r = min(LIMIT, exp(m * size / mean size)), with one multiplier m per source: the maximum of the convex dual, found by
Newton steps, with bisection where a step would leave the bracket. Rates are then rounded into whole copies.

Only one scan reads the texts. It leaves (source, size, hash) per document and from that (source, size, number of documents),
and each Newton round is an aggregation of the latter by source, so a source that holds a third of all rows is only larger counts.
Copies are rounded from large to small sizes. Each size takes the whole number nearest to its rate and to the words that
larger sizes took too few or too many, among those numbers that leave the smaller sizes able to meet the target. Where none
does (one document is longer than all that is missing, say), the number with the smaller miss is taken. So a source ends within half
its smallest size of the target, or within half the size of the document that its smaller ones can't stand in for.
One row gathers a source's sizes for this: as many as there are different lengths of text, however many documents.
Copies that don't divide evenly go to the documents of the group with the smallest hashes: ranks within ranges of the hash,
plus the counts of the ranges before.

Targets: sources in code point order, null last, weigh 1, 2, 3 in turn and share 100 % of all sizes; a target stops at
LIMIT times its source's size, and the excess is shared again by weight until none is above.

Defined results: null and blank texts have size 0, are kept once and take nothing; a null source is a source; equal rows
(doc_id and text) get equal copies; an empty table gives no rows. Columns of any other name are passed through as they are. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, documents, join_hot, stage, stage_observed, text_or_empty

LIMIT = 3
WEIGHTS = (1.0, 2.0, 3.0)
ROUNDS = 80
TOLERANCE = 1e-9
#: What a constraint may be off by, relatively, when the rounds end; more is an error.
FAIR = 1e-3
#: Rows per table that are broadcast at most (some 40 bytes each); larger tables are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Sizes that one inner fold of the rounding goes through; its results are an array of this length.
FOLD = 512


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sizes(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, _source, _size (words), _h, the hash that orders documents of one size, and _doc, the document's own columns."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("_source"), F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("_size"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("_h"), F.struct(*docs.columns).alias("_doc"),
    )


def source_targets(per_source: DataFrame) -> DataFrame:
    """(_source, docs, source_size) with target and the source's number sid. One row per source is what comes together here.

    Ordered by limit / weight, the sources at their limit come first; the first that isn't sets the level of all others.
    """
    by_name = Window.orderBy(F.col("_source").isNull(), "_source")
    every = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    rows = per_source.withColumn("sid", F.row_number().over(by_name))
    rows = rows.withColumns(
        {
            "weight": F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))) + 1),
            "limit": F.col("source_size") * F.lit(float(LIMIT)),
        }
    ).withColumn("ratio", F.col("limit") / F.col("weight"))
    rows = rows.withColumns(
        {
            "tokens": F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    rows = rows.withColumn("full", F.col("ratio") * F.col("weights") <= F.col("tokens"))
    level = F.min(F.when(~F.col("full"), F.struct("ratio", "sid", (F.col("tokens") / F.col("weights")).alias("level")))).over(every)
    return rows.withColumn("level", level["level"]).select(
        "_source", "sid", "docs", "source_size",
        F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("level"))).alias("target"),
    )


def _rate(m, size, mean):
    return F.least(F.lit(float(LIMIT)), F.exp(F.least(m * size / mean, F.lit(20.0))))


def _exact_sum(c):
    """A sum that doesn't depend on the order of the rows, so that reruns agree."""
    return F.sum(c.cast("decimal(32,6)")).cast("double")


def solve(counts: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """(sid, target, mean, m): Newton's method on every source's dual at once. counts: (sid, _size, n)."""
    mean = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0))
    start = F.when(F.col("target") >= F.col("source_size") * F.lit(float(LIMIT)), 2 * F.col("mean")).otherwise(
        F.log(F.greatest("target", F.lit(1e-9)) / F.greatest("source_size", F.lit(1)))
    )
    state = targets.withColumn("mean", mean).select(
        "sid", "target", "mean", (-60 * F.col("mean")).alias("lo"), (2 * F.col("mean")).alias("hi"), start.alias("m"), F.lit(1.0).alias("off")
    )
    state = checkpoint(state)
    for _ in range(ROUNDS):
        rate = _rate(F.col("m"), F.col("_size"), F.col("mean"))
        sums = (
            counts.join(_bounded(state, n_sources), "sid")
            .withColumns({"r": rate, "mass": F.col("n") * F.col("_size")})
            .groupBy("sid", "target", "mean", "lo", "hi", "m")
            .agg(
                _exact_sum(F.col("mass") * F.col("r")).alias("got"),
                _exact_sum(F.when(F.col("r") < float(LIMIT), F.col("mass") * F.col("r") * F.col("_size") / F.col("mean")).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("got") - F.col("target")
        sums = sums.withColumns(
            {
                "off": F.abs(gap) / F.greatest("target", F.lit(1.0)),
                "lo": F.when(gap < 0, F.col("m")).otherwise(F.col("lo")),
                "hi": F.when(gap > 0, F.col("m")).otherwise(F.col("hi")),
                "step": F.when(F.col("slope") > 0, F.col("m") - gap / F.col("slope")),
            }
        )
        inside = (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        new = F.when(F.col("off") <= TOLERANCE, F.col("m")).when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state, seen = stage_observed(sums.select("sid", "target", "mean", "lo", "hi", new.alias("m"), "off"), "tilts", worst=F.max("off"))
        if seen["worst"] is None or seen["worst"] <= TOLERANCE:
            break
    else:
        if seen["worst"] > FAIR:
            raise ArithmeticError(f"a source's constraint is off by {seen['worst']:.2g} after {ROUNDS} rounds")
    return state


def _let(value, use):
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _take(a, x):
    """One step of the rounding: a is what is left to take, what smaller sizes can take, and the error so far; x is a size."""
    size, most = x["_size"].cast("double"), (LIMIT * x["n"]).cast("double")
    below = a["below"] - most * size
    lo = F.greatest(F.lit(0.0), F.ceil((a["left"] - below) / size).cast("double"))
    hi = F.least(most, F.greatest(F.lit(0.0), F.floor(a["left"] / size).cast("double")))
    wish = F.round(x["want"] + a["error"] / size)
    over = (hi + 1) * size - a["left"]
    nearest = F.when((hi < most) & (a["left"] > 0) & (over < a["left"] - hi * size - below), hi + 1).otherwise(hi)
    copies = F.when(lo <= hi, F.greatest(lo, F.least(hi, wish))).otherwise(nearest)
    return _let(
        copies,
        lambda c: F.struct(
            (a["left"] - c * size).alias("left"), below.alias("below"), (a["error"] + (x["want"] - c) * size).alias("error"),
            F.array_append(a["copies"], c.cast("long")).alias("copies"),
        ),
    )


def _fold(target, sizes):
    """The copies of each of sizes, largest first, for one source: folds of FOLD sizes each, inside a fold over these."""
    none = F.array().cast("array<bigint>")
    capacity = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + LIMIT * x["n"] * x["_size"])
    first = F.struct(target.alias("left"), capacity.alias("below"), F.lit(0.0).alias("error"), F.array().cast("array<array<bigint>>").alias("parts"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / FOLD).cast("int")), lambda k: F.slice(sizes, k * FOLD + 1, F.lit(FOLD)))

    def block(a, part):
        inner = F.aggregate(part, F.struct(a["left"], a["below"], a["error"], none.alias("copies")), _take)
        return _let(inner, lambda b: F.struct(b["left"], b["below"], b["error"], F.array_append(a["parts"], b["copies"]).alias("parts")))

    return F.flatten(F.aggregate(blocks, first, block, lambda a: a["parts"]))


def round_copies(counts: DataFrame, state: DataFrame, n_sources: int) -> DataFrame:
    """(sid, _size, n, copies): whole copies per size; documents without words are kept once."""
    want = F.round(F.col("n") * _rate(F.col("m"), F.col("_size"), F.col("mean")), 6)
    per_source = (
        counts.filter("_size > 0")
        .join(_bounded(state.select("sid", "target", "mean", "m"), n_sources), "sid")
        .groupBy("sid", "target")
        .agg(F.sort_array(F.collect_list(F.struct("_size", "n", want.alias("want"))), asc=False).alias("sizes"))
    )
    rows = per_source.select("sid", F.explode(F.arrays_zip("sizes", _fold(F.col("target"), F.col("sizes")).alias("copies"))).alias("x"))
    rows = rows.select("sid", "x.sizes._size", "x.sizes.n", "x.copies")
    return rows.unionByName(counts.filter("_size = 0").select("sid", "_size", "n", F.col("n").alias("copies")))


def plan(thin: DataFrame) -> tuple[DataFrame, int]:
    """Of rows (_source, _size, _h): what `copies_of` needs per source and size, and the number of its rows."""
    counted = stage(thin.groupBy("_source", "_size").agg(F.count("*").alias("n")), "sizes")
    per_source = counted.groupBy("_source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("_size")).alias("source_size"))
    targets = checkpoint(source_targets(per_source))
    n_sources = targets.count()
    counts = checkpoint(
        counted.join(_bounded(targets.select("sid", F.col("_source").alias("s")), n_sources), F.col("_source").eqNullSafe(F.col("s"))).select("sid", "_source", "_size", "n")
    )
    state = solve(counts, targets, n_sources)
    rounded = round_copies(counts.drop("_source"), state, n_sources)
    groups = rounded.join(_bounded(targets.select("sid", F.col("_source").alias("g_source"), "source_size", "target"), n_sources), "sid").select(
        "g_source", F.col("_size").alias("g_size"), "source_size", "target", F.col("n").alias("g_n"),
        F.expr("copies div n").alias("each"), F.expr("copies % n").alias("extra"),
    )
    groups = checkpoint(groups)
    n_groups = groups.count()
    same = F.col("_source").eqNullSafe(F.col("g_source")) & (F.col("_size") == F.col("g_size"))
    # the hash of the last document that gets one more: its range of hashes, then its rank in the range
    uneven = groups.filter("extra > 0").select("g_source", "g_size", "extra")
    ranged = thin.select("_source", "_size", "_h", F.shiftright("_h", 56).alias("range"))
    some = ranged.join(_bounded(uneven, n_groups), same).drop("g_source", "g_size")
    per_range = some.groupBy("_source", "_size", "extra", "range").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("_source", "_size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        per_range.withColumn("earlier", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
        .filter("earlier < extra and extra <= earlier + n")
        .select(F.col("_source").alias("c_source"), F.col("_size").alias("c_size"), F.col("range").alias("c_range"), (F.col("extra") - F.col("earlier")).alias("rank"))
    )
    in_range = Window.partitionBy("_source", "_size", "range").orderBy("_h")
    last = (
        ranged.join(_bounded(checkpoint(cut), n_groups), F.col("_source").eqNullSafe(F.col("c_source")) & (F.col("_size") == F.col("c_size")) & (F.col("range") == F.col("c_range")))
        .withColumn("place", F.row_number().over(in_range))
        .filter("place = rank")
        .select("c_source", "c_size", F.col("_h").alias("last"))
    )
    last = last.select(F.col("c_source").alias("l_source"), F.col("c_size").alias("l_size"), "last")
    whole = groups.join(last, F.col("g_source").eqNullSafe(F.col("l_source")) & (F.col("g_size") == F.col("l_size")), "left")
    return checkpoint(whole.select(_key("g_source").alias("g_key"), "g_size", "g_n", "source_size", "target", "each", "last")), n_groups


def _key(source: str):
    """A source as a text that is never null."""
    return F.concat(F.when(F.col(source).isNull(), "0").otherwise("1"), F.coalesce(F.col(source), F.lit("")))


def copies_of(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Adds source_size, target and copies to rows with _source, _size and _h.

    More than BROADCAST_ROWS groups are joined by a shuffle of the rows, except that the rows of large groups stay where they are."""
    keyed, on = groups.withColumnsRenamed({"g_key": "_key", "g_size": "_size"}), ["_key", "_size"]
    rows = rows.withColumn("_key", _key("_source"))
    if n_groups <= BROADCAST_ROWS:
        found = rows.join(F.broadcast(keyed), on)
    else:
        found = join_hot(rows, keyed, on, "g_n", groups.agg(F.sum("g_n")).first()[0])
    copies = F.col("each") + F.when(F.col("_h") <= F.col("last"), 1).otherwise(0)
    return found.withColumn("copies", copies.cast("long")).drop("_key", "g_n", "each", "last")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, each as often as the mix takes it. The texts aren't shuffled, unless there are more than BROADCAST_ROWS groups (`copies_of`)."""
    groups, n = plan(stage(sizes(docs, text, source, doc_id).select("_source", "_size", "_h"), "thin"))
    taken = copies_of(sizes(docs, text, source, doc_id).select("_source", "_size", "_h", "_doc"), groups, n).filter("copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_doc.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = stage(sizes(documents(spark, sf_dir)).select("doc_id", "_source", "_size", "_h"), "thin")
    groups, n = plan(thin)
    return copies_of(thin, groups, n).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"), "copies"
    )
