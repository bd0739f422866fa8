"""Near-duplicate embeddings by NN-descent.

0. Equal vectors of a label are folded into one with their number; the smallest vec_id stands for them, and only it goes on.
1. Vectors become unit vectors (double precision), grouped by label and dimension. Random hyperplanes deal each group into
   buckets of about BLOCK, several times over; each bucket gives its vectors their first NEIGHBOURS neighbours.
2. A round joins every vector's neighbours and reverse neighbours with one another: whatever brings a vector a nearer
   neighbour than the farthest on its list goes on the list. Rounds end when they find no more links (cosine >= THRESHOLD).
3. A list is saturated when all of it are links. Saturated lists are doubled and the rounds go on, until no list is saturated or
   doubling joined no more components.
4. Components that hold a vector whose list is still saturated are compared with all other components of their group, in
   blocks, as those of vectors whose links the audit finds in several components: such a comparison sends on only pairs of components.
5. Recall is audited: every vector with a vec_id divisible by AUDIT is compared with all vectors of its group, in blocks; recall is the mean over
   these vectors of the share of their links that is within their component. Below RECALL, all lists are doubled and the rounds go
   on, as long as that raises recall; then all of the groups with a miss are compared, which leaves nothing open in them.
6. Links are then counted exactly within each component, blocks of COUNTED against each other; counts are sent on, never pairs.
   Components of one block, nearly all, are one group; a larger one costs its square in products, in tasks of fixed size, and sends each
   vector once for each of its blocks.

Defined results: vectors that are null, zero, without label, or hold null or non-finite values link with nothing; so do
vectors of different lengths; rows with one vec_id are one vector for links, and each row is returned; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, join_hot, stage
from .graph import components, join_components

THRESHOLD = 0.93
NEIGHBOURS = 10
BLOCK, COUNTED = 256, 1024
TABLES, BITS = 4, 14
AUDIT, RECALL = 100, 0.99
ROUNDS = 8


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, units, codes = [], [], [], []
        for i, x, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            if i is None or label is None or not x.is_valid or not len(x.values) or x.values.null_count:
                continue
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(v).max()
            if not np.isfinite(top) or top == 0:
                continue
            v = v / top
            v = v / np.sqrt(v @ v)
            planes = np.random.default_rng(len(v)).standard_normal((TABLES * BITS, len(v)))
            bits = (planes @ v > 0).reshape(TABLES, BITS) @ (1 << np.arange(BITS))
            ids.append(i)
            keys.append(f"{label}/{len(v)}")
            units.append(v.tobytes())
            codes.append(bits.tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(units, pa.binary()), pa.array(codes, pa.list_(pa.int32()))], ["id", "g", "v", "codes"]
        )


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), dtype=np.float64) for x in column])


def _nearest(table: pa.Table) -> pa.Table:
    """Each vector's NEIGHBOURS nearest within a bucket."""
    ids, x = table.column("id").to_numpy(), _matrix(table.column("v"))
    s = x @ x.T
    s[ids[:, None] == ids[None, :]] = -2
    k = min(NEIGHBOURS, len(ids) - 1)
    if k < 1:
        return pa.table({"id": pa.array([], pa.int64()), "nb": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), k)
    sims = s[rows, best.ravel()]
    good = sims > -2
    return pa.table({"id": pa.array(ids[rows][good]), "nb": pa.array(ids[best.ravel()][good]), "sim": pa.array(sims[good])})


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Among one vector's neighbours: pairs that are nearer than the farthest on the list of the first."""
    for batch in batches:
        a, b, sims = [], [], []
        for members in batch.column(0):
            flat = members.values
            ids, least = flat.field("nb").to_numpy(), flat.field("least").to_numpy()
            if len(ids) < 2:
                continue
            x = _matrix(flat.field("v"))
            s = x @ x.T
            s[ids[:, None] == ids[None, :]] = -2
            i, j = np.nonzero(s > np.maximum(least[:, None], -1))
            a.append(ids[i])
            b.append(ids[j])
            sims.append(s[i, j])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
        yield pa.RecordBatch.from_arrays([join(a, np.int64), join(b, np.int64), join(sims, np.float64)], ["id", "nb", "sim"])


def _best(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nearest neighbours of each id, as many as its list takes. sizes: (id, k)."""
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "nb")
    once = edges.groupBy("id", "nb").agg(F.max("sim").alias("sim"))
    return once.join(sizes, "id").withColumn("place", F.row_number().over(w)).filter("place <= k").select("id", "nb", "sim", "k", "place")


def _round(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """Candidate edges from joining neighbours with one another."""
    least = lists.groupBy("id").agg(F.when(F.count("*") >= F.max("k"), F.min("sim")).otherwise(-2.0).alias("least")).withColumnRenamed("id", "nb")
    back = Window.partitionBy("nb").orderBy(F.desc("sim"), "id")
    reverse = lists.withColumn("place", F.row_number().over(back)).filter("place <= k").select(F.col("nb").alias("id"), F.col("id").alias("nb"))
    around = lists.select("id", "nb").unionByName(reverse).distinct()
    return (
        around.join(least, "nb", "left")
        .join(vectors.select(F.col("id").alias("nb"), "v"), "nb")
        .groupBy("id")
        .agg(F.collect_list(F.struct("nb", F.coalesce("least", F.lit(-2.0)).alias("least"), "v")).alias("members"))
        .select("members")
        .mapInArrow(_local_join, "id long, nb long, sim double")
    )


def _counts(table: pa.Table) -> pa.Table:
    """Links of each vector of the first block to the second block (or within one), equal vectors counted as many times as they are."""
    ids, first = table.column("id").to_numpy(), table.column("first").to_numpy(zero_copy_only=False).astype(bool)
    second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
    x, n = _matrix(table.column("v")), table.column("n").to_numpy()
    near = x[first] @ x[second].T >= THRESHOLD
    near &= ids[first][:, None] != ids[second][None, :]
    return pa.table({"id": pa.array(ids[first]), "n": pa.array(near @ n[second])})


def _dealt(rows: DataFrame, blocks: DataFrame, on: str) -> DataFrame:
    """rows with p and q, the numbers of blocks of their group: 1 but for large groups, so these are few and can be broadcast."""
    large = F.broadcast(blocks.filter("p > 1 or q > 1"))
    return rows.join(large, on, "left").withColumns({"p": F.coalesce("p", F.lit(1)), "q": F.coalesce("q", F.lit(1))})


def _blocked(on: str, firsts: DataFrame, seconds: DataFrame, total: int) -> DataFrame:
    """(id, n): for each of firsts, its links among seconds of equal `on`. Both: (id, on, v, n). A pair of blocks is a group."""
    size = max(COUNTED, -(-total // HOT_KEYS))
    sizes = firsts.groupBy(on).agg(F.count("*").alias("nf")).join(seconds.groupBy(on).agg(F.count("*").alias("ns")), on)
    blocks = stage(sizes.select(on, "ns", F.ceil(F.col("nf") / size).cast("int").alias("p"), F.ceil(F.col("ns") / size).cast("int").alias("q")), "blocks")
    own = F.xxhash64("id")
    left = _dealt(firsts, blocks, on).select(on, "id", "v", "n", F.pmod(own, F.col("p")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), F.lit(True).alias("first"), F.lit(False).alias("second"))
    asked = _dealt(seconds, blocks, on) if firsts is seconds else join_hot(seconds, blocks, [on], "ns", total)
    right = asked.select(on, "id", "v", "n", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), F.pmod(own, F.col("q")).cast("int").alias("j"), F.lit(False).alias("first"), F.lit(True).alias("second"))
    both = left.unionByName(right)
    return both.groupBy(on, "i", "j").applyInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _across(table: pa.Table) -> pa.Table:
    """The pairs of components (a < b) with a link between the first block and the second."""
    of = table.column("c").to_numpy()
    first = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
    x = _matrix(table.column("v"))
    p, q = of[first], of[~first]
    i, j = np.nonzero((x[first] @ x[~first].T >= THRESHOLD) & (p[:, None] != q[None, :]))
    pairs = np.unique(np.stack((np.minimum(p[i], q[j]), np.maximum(p[i], q[j])), axis=1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _members(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, g, v, n, asked, c): every vector with its component, itself where it has no link."""
    return vectors.join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", "g", "v", "n", "asked", F.coalesce("component", "id").alias("c"))


def compare_blocks(labels: DataFrame, vectors: DataFrame, open_: DataFrame, total: int) -> DataFrame:
    """labels, (node, component), joined by every link between the open components, (c), and the other components of their groups.
    total: no less than the number of vectors."""
    rows = _members(labels, vectors)
    loose = rows.join(open_.select("c").distinct(), "c", "left_semi")
    several = rows.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("g")
    sizes = loose.groupBy("g").agg(F.count("*").alias("nf")).join(several, "g").join(rows.groupBy("g").agg(F.count("*").alias("ns")), "g")
    blocks = stage(sizes.select("g", "nf", "ns", F.ceil(F.col("nf") / BLOCK).cast("int").alias("p"), F.ceil(F.col("ns") / BLOCK).cast("int").alias("q")), "open")
    own = F.xxhash64("id")
    left = join_hot(loose, blocks, ["g"], "nf", total).select("g", "c", "v", F.pmod(own, F.col("p")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("j"), F.lit(True).alias("first"))
    right = join_hot(rows, blocks, ["g"], "ns", total).select("g", "c", "v", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), F.pmod(own, F.col("q")).cast("int").alias("j"), F.lit(False).alias("first"))
    more = stage(left.unionByName(right).groupBy("g", "i", "j").applyInArrow(_across, "a long, b long").distinct(), "across")
    return join_components(labels, more) if more.limit(1).count() else labels


def audit(labels: DataFrame, vectors: DataFrame, total: int) -> tuple[float, DataFrame]:
    """The mean, over the vectors with a vec_id divisible by AUDIT that have links, of the share of their links within their component; and
    (id, g, c) of those that miss some. labels: (node, component)."""
    true = _blocked("g", vectors.filter("asked").select("id", "g", "v", "n"), vectors.select("id", "g", "v", "n"), total)
    same = _members(labels, vectors).withColumn("on", F.concat_ws("/", "g", "c"))
    have = _blocked("on", same.filter("asked").select("id", "on", "v", "n"), same.select("id", "on", "v", "n"), total)
    rows = stage(true.join(have.withColumnRenamed("n", "m"), "id", "left").filter("n > 0").select("id", "n", F.coalesce("m", F.lit(0)).alias("m")), "audit")
    recall = rows.agg(F.avg(F.col("m") / F.col("n"))).first()[0]
    return 1.0 if recall is None else recall, same.join(rows.filter("m < n"), "id").select("id", "g", "c")


def link(rows: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """(id, n_links, component_id) of the vectors that can link."""
    raw = stage(
        rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
        .mapInArrow(_prepare, "id long, g string, v binary, codes array<int>")
        .withColumn("d", F.unhex(F.md5("v"))),
        "units",
    )
    thin = stage(raw.select("id", "g", "d").distinct(), "ids")
    folded = stage(thin.groupBy("g", "d").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.bool_or(F.col("id") % AUDIT == 0).alias("asked")), "folded")
    total = thin.count()
    reps = raw.join(folded.withColumnRenamed("rep", "id"), ["id", "g", "d"]).dropDuplicates(["id", "g", "d"])
    vectors = stage(reps.select("id", "g", "v", "codes", "n", "asked"), "vectors")
    stands = join_hot(thin, folded.select("g", "d", "rep", "n"), ["g", "d"], "n", total).select("id", "rep", F.col("n").alias("alike"))
    stands = stage(stands, "stands")
    bits = F.greatest(F.lit(0), F.least(F.lit(BITS), F.ceil(F.log2(F.count("*") / F.lit(BLOCK / 2))).cast("int")))
    sizes = stage(vectors.groupBy("g").agg(F.count("*").alias("in_g"), bits.alias("bits")), "sizes")
    coded = join_hot(vectors, sizes, ["g"], "in_g", total).select("id", "g", "v", "bits", F.posexplode("codes").alias("t", "code"))
    coded = coded.withColumn("bucket", F.col("code").bitwiseAND(F.expr("shiftleft(1, bits) - 1")))
    # a bucket that holds too many is dealt out again by a hash, another one in each table
    parts = stage(coded.groupBy("g", "t", "bucket").agg(F.count("*").alias("in_bucket"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "parts")
    dealt = join_hot(coded, parts, ["g", "t", "bucket"], "in_bucket", TABLES * total).withColumn("part", F.pmod(F.xxhash64("id", "t"), F.col("parts")))
    first = dealt.select("id", "v", "g", "t", "bucket", "part").groupBy("g", "t", "bucket", "part").applyInArrow(_nearest, "id long, nb long, sim double")
    caps = vectors.select("id").distinct().withColumn("k", F.lit(NEIGHBOURS))
    lists = stage(_best(first, caps), "lists")
    n_found, n_components, reached = -1, None, -1.0
    while True:
        for _ in range(ROUNDS):
            lists = stage(_best(lists.select("id", "nb", "sim").unionByName(_round(lists, vectors)), lists.select("id", "k").distinct()), "lists")
            before, n_found = n_found, lists.filter(F.col("sim") >= THRESHOLD).count()
            if n_found == before:
                break
        labels = components(lists.filter(F.col("sim") >= THRESHOLD).select(F.col("id").alias("a"), F.col("nb").alias("b")))
        full = lists.groupBy("id").agg(F.max("k").alias("k"), ((F.count("*") >= F.max("k")) & (F.min("sim") >= THRESHOLD)).alias("full"))
        now = labels.agg(F.countDistinct("component")).first()[0]
        grown = full.select("id", F.when(F.col("full"), 2 * F.col("k")).otherwise(F.col("k")).alias("k"))
        saturated = full.filter("full")
        left = saturated.limit(1).count()
        if not left or now == n_components:
            if left:
                labels = compare_blocks(labels, vectors, labels.join(saturated, F.col("node") == F.col("id")).select(F.col("component").alias("c")), total)
            recall, missed = audit(labels, vectors, total)
            if recall >= RECALL or recall <= reached:
                if missed.limit(1).count():
                    open_ = missed
                    if recall < RECALL:
                        groups = stage(sizes.join(missed.select("g").distinct(), "g", "left_semi"), "missed")
                        open_ = join_hot(_members(labels, vectors), groups, ["g"], "in_g", total)
                    labels = compare_blocks(labels, vectors, open_.select("c"), total)
                break
            reached = recall
            grown = full.select("id", 2 * F.col("k"))
        n_components, n_found = now, -1
        lists = stage(lists.drop("k").join(grown.toDF("id", "k"), "id"), "lists")
    # rows of one vec_id with different vectors are one
    several = stands.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("id", F.col("lo").alias("a"))
    more = stage(several.join(stands, "id").filter("a <> rep").select("a", F.col("rep").alias("b")), "same_id")
    if more.limit(1).count():
        labels = join_components(labels, more)
    within = stage(vectors.join(labels.withColumnRenamed("node", "id"), "id").select("id", "component", "v", "n"), "within")
    counts = _blocked("component", within, within, total)
    known = vectors.groupBy("id").agg(F.max("n").alias("alike")).join(counts, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    known = stage(known.select(F.col("id").alias("rep"), "alike", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "id").alias("component")), "counts")
    found = join_hot(stands.select("id", "rep", F.col("alike").alias("own")), known, ["rep"], "alike", total)
    return found.groupBy("id").agg(F.sum(F.col("n") + F.col("own") - 1).alias("n_links"), F.min("component").alias("component_id"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = link(rows)
    return (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"))
        .join(found, F.col("vec_id") == F.col("id"), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
