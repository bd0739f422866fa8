"""Experiments: assignment, observations, effects, corrections, intervals, gates; and the reranking pipeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, scoring
from ..operators import rerank
from ..operators.intervals import interval_left_join
from ..operators.joins import as_of
from ..sources.sinks import stage
from ..sources.tables import Domain
from .registry import query
from .scoring import SURFACES

_VARIANT = "CASE WHEN ('0x' || substr(sha256('exp-1:' || user_id), 1, 8))::BIGINT % 10000 < 5000 THEN 'baseline' ELSE 'treatment' END"
_OBS = f"""obs AS (SELECT m.user_id, segment, {_VARIANT} AS variant, count(o_orderkey) AS orders, coalesce(sum(o_totalprice), 0) / 1000 AS spend FROM members m LEFT JOIN orders ON o_custkey = m.user_id WHERE active GROUP BY 1, 2, 3)"""
_LONG = """long AS (SELECT user_id, segment, variant, 'orders' AS metric, orders::DOUBLE AS v FROM obs UNION ALL SELECT user_id, segment, variant, 'spend', spend FROM obs)"""


def observations(d: Domain) -> DataFrame:
    """One row per active member and metric: segment, variant, v."""
    variant = F.when(hashing.bucket(F.concat(F.lit("exp-1:"), F.col("user_id").cast("string"))) < 5000, "baseline").otherwise("treatment")
    o = d.table("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spend"))
    rows = d.members.filter("active").join(o, "user_id", "left").select("user_id", "segment", variant.alias("variant"), F.coalesce("orders", F.lit(0)).cast("double").alias("orders"), (F.coalesce("spend", F.lit(0.0)) / 1000).alias("spend"))
    return rows.unpivot(["user_id", "segment", "variant"], ["orders", "spend"], "metric", "v")


@query("experiment_assignment", f"SELECT variant, segment, count(*) AS members FROM (SELECT {_VARIANT} AS variant, segment FROM members WHERE active) GROUP BY ROLLUP (variant, segment)", ("members",))
def experiment_assignment(d: Domain) -> DataFrame:
    """Members per variant and segment, with both totals."""
    rows = observations(d).filter("metric = 'orders'")
    return rows.rollup("variant", "segment").agg(F.count("*").alias("members"))


# Half-open window of observation, and how long an exposure's engagement counts.
OBSERVED_FROM, OBSERVED_TO, ENGAGED_DAYS = "2024-01-04 00:00:00", "2024-01-27 00:00:00", 7
_FROM, _TO = f"TIMESTAMP '{OBSERVED_FROM}'", f"TIMESTAMP '{OBSERVED_TO}'"
#: Members are assigned one after the other; a view is an exposure of a run of the member, an inactive member's too.
_ASSIGNED = f"""assigned AS (SELECT user_id AS assignment_id, user_id, {_VARIANT} AS variant, TIMESTAMP '2024-01-03 00:00:00' + to_days((user_id % 28)::INTEGER) AS assigned_at FROM members WHERE active),
    shown AS (SELECT event_id AS exposure_id, user_id, user_id * 10 + post_id % 10 AS run_id, ts AS exposed_at FROM behaviour WHERE kind = 'view'),
    acts AS (SELECT event_id, user_id, user_id * 10 + post_id % 10 AS run_id, ts AS occurred_at FROM behaviour WHERE kind IN ('click', 'save')),
    profiles AS (SELECT user_id, ts AS made_at, event_id, (['explicit_only', 'emerging', 'established'])[1 + event_id % 3] AS segment FROM behaviour WHERE kind = 'follow')"""


def _at(text: str):
    return F.lit(text).cast("timestamp")


def assignments(d: Domain) -> DataFrame:
    variant = F.when(hashing.bucket(F.concat(F.lit("exp-1:"), F.col("user_id").cast("string"))) < 5000, "baseline").otherwise("treatment")
    days = F.make_dt_interval(days=(F.col("user_id") % 28).cast("int"))
    return d.members.filter("active").select(F.col("user_id").alias("assignment_id"), "user_id", variant.alias("variant"), (_at("2024-01-03 00:00:00") + days).alias("assigned_at"))


def experiment_exposures(d: Domain) -> DataFrame:
    return d.behaviour.filter("kind = 'view'").select(F.col("event_id").alias("exposure_id"), "user_id", (F.col("user_id") * 10 + F.col("post_id") % 10).alias("run_id"), F.col("ts").alias("exposed_at"))


@query(
    "exposures_in_window",
    f"WITH {_ASSIGNED} SELECT assignment_id, variant, assigned_at, exposure_id, exposed_at FROM assigned a LEFT JOIN shown x ON x.user_id = a.user_id AND x.exposed_at >= a.assigned_at AND x.exposed_at < a.assigned_at + INTERVAL 7 DAY",
    ("members", "behaviour"),
)
def exposures_in_window(d: Domain) -> DataFrame:
    """Every assignment with the exposures of its first seven days, or none."""
    left = assignments(d).withColumn("until", F.col("assigned_at") + F.expr("interval 7 days"))
    rows = interval_left_join(left, experiment_exposures(d), ["user_id"], ["assignment_id"], "assigned_at", "until", "exposed_at", 7 * 86_400)
    return rows.select("assignment_id", "variant", "assigned_at", "exposure_id", "exposed_at")


@query(
    "experiment_observations",
    f"""WITH {_ASSIGNED} SELECT a.assignment_id, coalesce((SELECT arg_max(p.segment, (p.made_at, p.event_id)) FROM profiles p WHERE p.user_id = a.user_id AND p.made_at < {_TO}), 'empty') AS segment, a.variant, a.assigned_at, count(DISTINCT x.exposure_id) AS exposures,
        count(DISTINCT x.run_id) AS runs, count(DISTINCT x.run_id) FILTER (WHERE x.run_id % 7 = 0) AS fallbacks, count(DISTINCT b.event_id) FILTER (WHERE b.occurred_at >= x.exposed_at AND b.occurred_at < least({_TO}, x.exposed_at + INTERVAL {ENGAGED_DAYS} DAY)) AS engagements, min(x.exposed_at) AS first_exposed_at
    FROM assigned a LEFT JOIN shown x ON x.user_id = a.user_id AND x.exposed_at >= {_FROM} AND x.exposed_at < {_TO} LEFT JOIN acts b ON b.run_id = x.run_id AND b.user_id = a.user_id WHERE a.assigned_at < {_TO} GROUP BY a.assignment_id, a.user_id, a.variant, a.assigned_at""",
    ("members", "behaviour"),
)
def experiment_observations(d: Domain) -> DataFrame:
    """Assignments before the end of the window with their exposures inside it and what these led to; an assignment without any has zeros.

    No exposure meets every act of its run: an act counts if the run's latest exposure up to it isn't older than ENGAGED_DAYS,
    which one sort per run tells. The window stands on the exposures, before the left join, so that it drops no assignment."""
    to = _at(OBSERVED_TO)
    shown = experiment_exposures(d).filter((F.col("exposed_at") >= _at(OBSERVED_FROM)) & (F.col("exposed_at") < to))
    runs = shown.groupBy("user_id", "run_id").agg(F.countDistinct("exposure_id").alias("n"), F.min("exposed_at").alias("first"))
    acts = d.behaviour.filter("kind in ('click', 'save')").select("event_id", "user_id", (F.col("user_id") * 10 + F.col("post_id") % 10).alias("run_id"), F.col("ts").alias("occurred_at")).filter(F.col("occurred_at") < to)
    last = as_of(acts, shown, ["user_id", "run_id"], "occurred_at", "exposed_at", "exposure_id").filter(F.col("occurred_at") < F.col("exposed_at") + F.make_dt_interval(days=F.lit(ENGAGED_DAYS)))
    engaged = last.groupBy("user_id").agg(F.countDistinct("event_id").alias("engagements"))
    seen = runs.groupBy("user_id").agg(F.sum("n").alias("exposures"), F.count("*").alias("runs"), F.count_if(F.col("run_id") % 7 == 0).alias("fallbacks"), F.min("first").alias("first_exposed_at"))
    profiles = d.behaviour.filter((F.col("kind") == "follow") & (F.col("ts") < to)).groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("p"))
    names = ("explicit_only", "emerging", "established")
    segment = F.when(F.col("p").isNotNull(), F.element_at(F.array(*map(F.lit, names)), (1 + F.col("p.event_id") % 3).cast("int")))
    rows = assignments(d).filter(F.col("assigned_at") < to).join(seen, "user_id", "left").join(engaged, "user_id", "left").join(profiles, "user_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("assignment_id", F.coalesce(segment, F.lit("empty")).alias("segment"), "variant", "assigned_at", *map(zero, ("exposures", "runs", "fallbacks", "engagements")), "first_exposed_at")


@query(
    "exposure_audit",
    f"WITH {_ASSIGNED} SELECT count(*) FILTER (WHERE a.user_id IS NOT NULL AND (x.exposed_at < {_FROM} OR x.exposed_at >= {_TO})) AS out_of_window, count(*) FILTER (WHERE a.user_id IS NULL) AS unassigned, count(*) AS exposures FROM shown x LEFT JOIN assigned a USING (user_id)",
    ("members", "behaviour"),
)
def exposure_audit(d: Domain) -> DataFrame:
    """Exposures that an evaluation must not meet: those outside the window, and those of members without an assignment."""
    rows = experiment_exposures(d).join(assignments(d).select("user_id", F.lit(True).alias("known")), "user_id", "left")
    inside = (F.col("exposed_at") >= _at(OBSERVED_FROM)) & (F.col("exposed_at") < _at(OBSERVED_TO))
    return rows.agg(F.count_if(F.col("known").isNotNull() & ~inside).alias("out_of_window"), F.count_if(F.col("known").isNull()).alias("unassigned"), F.count("*").alias("exposures"))


_EFFECTS = f"""{_OBS}, {_LONG}, g AS (SELECT coalesce(segment, 'all') AS segment, metric, count(*) FILTER (WHERE variant = 'baseline') AS na, count(*) FILTER (WHERE variant = 'treatment') AS nb,
    coalesce(avg(v) FILTER (WHERE variant = 'baseline'), 0) AS ma, coalesce(avg(v) FILTER (WHERE variant = 'treatment'), 0) AS mb,
    coalesce(var_samp(v) FILTER (WHERE variant = 'baseline'), 0) AS va, coalesce(var_samp(v) FILTER (WHERE variant = 'treatment'), 0) AS vb FROM long GROUP BY ROLLUP (segment), metric HAVING metric IS NOT NULL),
    e AS (SELECT *, mb - ma AS effect, CASE WHEN na > 0 AND nb > 0 AND na + nb > 2 THEN sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) ELSE 0 END AS pooled, CASE WHEN na > 1 AND nb > 1 THEN sqrt(va / na + vb / nb) END AS se FROM g),
    t AS (SELECT *, CASE WHEN se > 0 THEN abs(effect / se) END AS z, CASE WHEN pooled > 0 THEN effect / pooled ELSE 0.0 END AS size FROM e),
    k AS (SELECT *, 1 / (1 + 0.2316419 * z) AS t FROM t),
    p AS (SELECT *, CASE WHEN se IS NULL THEN 1.0 WHEN se = 0 THEN CASE WHEN effect = 0 THEN 1.0 ELSE 0.0 END ELSE least(1.0, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))) END AS p FROM k)"""


def effects(d: Domain) -> DataFrame:
    """Per segment (and all) and metric: means, variances, effect, its size and two-sided p-value."""
    return effect_columns(observations(d))


def effect_columns(obs: DataFrame) -> DataFrame:
    """obs: segment, metric, variant, v. One rollup gives the segments and their total.

    A variant without values has mean 0; the size is 0 without pooled variance; p is 1 where a variant has fewer than two values, and
    without any variance 1 for equal means, else 0.
    """
    of = lambda variant: F.when(F.col("variant") == variant, F.col("v"))
    a, b = of("baseline"), of("treatment")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = obs.groupingSets([["segment", "metric"], ["metric"]], "segment", "metric").agg(
        F.count(a).alias("na"), F.count(b).alias("nb"), zero(F.avg(a)).alias("ma"), zero(F.avg(b)).alias("mb"), zero(F.var_samp(a)).alias("va"), zero(F.var_samp(b)).alias("vb"),
        F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"),
    )
    na, nb, effect = F.col("na"), F.col("nb"), F.col("mb") - F.col("ma")
    some = (na > 0) & (nb > 0) & (na + nb > 2)
    pooled = F.when(some, F.sqrt(F.try_divide((na - 1) * F.col("va") + (nb - 1) * F.col("vb"), na + nb - 2))).otherwise(0.0)
    error = F.when((na > 1) & (nb > 1), F.sqrt(F.try_divide("va", "na") + F.try_divide("vb", "nb")))
    rows = rows.withColumns({"segment": F.coalesce("segment", F.lit("all")), "effect": effect, "pooled": pooled, "se": error})
    rows = rows.withColumns({"z": F.try_divide("effect", F.nullif(F.col("se"), F.lit(0.0))), "size": F.coalesce(F.try_divide("effect", F.nullif(F.col("pooled"), F.lit(0.0))), F.lit(0.0))})
    p = F.when(F.col("se").isNull(), 1.0).when(F.col("se") == 0, F.when(F.col("effect") == 0, 1.0).otherwise(0.0)).otherwise(scoring.normal_tail(F.col("z")))
    return rows.withColumn("p", p)


@query(
    "experiment_effects",
    f"WITH {_EFFECTS} SELECT segment, metric, na, nb, round(ma, 6) AS ma, round(mb, 6) AS mb, round(effect, 6) AS effect, round(size, 6) AS size, round(p, 6) AS p FROM p",
    ("members",),
)
def experiment_effects(d: Domain) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return effects(d).select("segment", "metric", "na", "nb", r("ma"), r("mb"), r("effect"), r("size"), r("p"))


_HOLM = f"""{_EFFECTS}, o AS (SELECT *, row_number() OVER (ORDER BY p, segment, metric) AS i, count(*) OVER () AS m FROM p),
    h AS (SELECT *, max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS adjusted FROM o)"""


@query("holm_correction", f"WITH {_HOLM} SELECT segment, metric, round(adjusted, 6) AS adjusted FROM h", ("members",))
def holm_correction(d: Domain) -> DataFrame:
    """Step-down over one family, all metrics of all segments: the i-th smallest of m p-values times m - i + 1, never below the one before."""
    return holm(effects(d)).select("segment", "metric", F.round("adjusted", 6).alias("adjusted"))


def holm(rows: DataFrame) -> DataFrame:
    """Adds adjusted. There is one row per segment and metric, so one task takes few rows."""
    w = Window.partitionBy(F.lit(0)).orderBy("p", "segment", "metric")
    rows = rows.withColumns({"_i": F.row_number().over(w), "_m": F.count("*").over(Window.partitionBy(F.lit(0)))})
    rows = rows.withColumn("_a", F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col("p")))
    return rows.withColumn("adjusted", F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_i", "_m", "_a")


@query(
    "common_support",
    f"WITH {_OBS} SELECT segment, count(*) FILTER (WHERE variant = 'baseline') AS a, count(*) FILTER (WHERE variant = 'treatment') AS b, round(2.0 * least(count(*) FILTER (WHERE variant = 'baseline'), count(*) FILTER (WHERE variant = 'treatment')) / count(*), 6) AS support, round(count(*) FILTER (WHERE orders = 0) / count(*), 6) AS missing FROM obs GROUP BY segment",
    ("members",),
)
def common_support(d: Domain) -> DataFrame:
    rows = observations(d).filter("metric = 'orders'").groupBy("segment")
    return rows.agg(F.count_if(F.col("variant") == "baseline").alias("a"), F.count_if(F.col("variant") == "treatment").alias("b"), F.round(F.count_if(F.col("v") == 0) / F.count("*"), 6).alias("missing")).withColumn(
        "support", F.round(2.0 * F.least("a", "b") / (F.col("a") + F.col("b")), 6)
    )


# Least members of a variant in all and in a segment, least support, most missing values, confidence, alpha, least size of an
# effect, regression that rolls back, seed and number of resamples.
LEAST_ALL, LEAST_SEGMENT, LEAST_SUPPORT, MOST_MISSING, CONFIDENCE, ALPHA, LEAST_SIZE, ROLLBACK = 100, 30, 0.80, 0.05, 0.95, 0.05, 0.10, 0.05
BOOTSTRAP_SEED, ITERATIONS = 91337, 10_000
#: Role, direction (1: higher is better), least effect, most regression of each metric.
METRICS = {"orders": ("PRIMARY", 1, 0.01, 0.0), "spend": ("GUARDRAIL", 1, 0.0, 0.02)}
#: Allowed steps of a release.
STEPS = {
    "DRAFT": ("SHADOW", "HOLD"), "SHADOW": ("CANARY", "HOLD"), "CANARY": ("LIVE", "HOLD", "ROLLED_BACK"), "LIVE": ("HOLD", "ROLLED_BACK"),
    "HOLD": ("SHADOW", "CANARY", "ROLLED_BACK"), "ROLLED_BACK": ("SHADOW",),
}
#: Resamples drawn from one seed, cells of a matrix of draws at a time, distinct values of a slice, the most often that a value drawn by itself occurs, and slices of a task.
DRAWS, CELLS, VALUES, FEW, SLICES_A_TASK = 500, 1 << 21, 2_048, 16, 8


@query(
    "experiment_quality",
    f"""WITH {_HOLM} SELECT segment, metric, round(CASE WHEN na + nb = 0 THEN 0.0 ELSE 2.0 * least(na, nb) / (na + nb) END, 6) AS support, least(na, nb) >= CASE WHEN segment = 'all' THEN {LEAST_ALL} ELSE {LEAST_SEGMENT} END AS sample_sufficient,
    CASE WHEN na + nb = 0 THEN false ELSE 2.0 * least(na, nb) / (na + nb) >= {LEAST_SUPPORT} END AS quality_pass, adjusted <= {ALPHA} AND effect >= 0.01 AND abs(size) >= {LEAST_SIZE} AS significant FROM h""",
    ("members",),
)
def experiment_quality(d: Domain) -> DataFrame:
    """Support, sample and data quality of each segment and metric, and whether its effect is one after correction."""
    rows = judged(holm(effects(d)))
    return rows.select("segment", "metric", F.round("support", 6).alias("support"), "sample_sufficient", "quality_pass", ((F.col("adjusted") <= ALPHA) & (F.col("effect") >= 0.01) & (F.abs("size") >= LEAST_SIZE)).alias("significant"))


def judged(rows: DataFrame) -> DataFrame:
    """Adds support, missing_rate, sample_sufficient and quality_pass."""
    least = F.when(F.col("segment") == "all", LEAST_ALL).otherwise(LEAST_SEGMENT)
    support = F.coalesce(F.try_divide(2.0 * F.least("na", "nb"), F.col("na") + F.col("nb")), F.lit(0.0))
    rows = rows.withColumns({"support": support, "missing_rate": F.coalesce(F.try_divide("missing", "n"), F.lit(1.0)), "sample_sufficient": F.least("na", "nb") >= least})
    return rows.withColumn("quality_pass", (F.col("support") >= LEAST_SUPPORT) & (F.col("missing_rate") <= MOST_MISSING))


def resampled(counts_a: np.ndarray, values_a: np.ndarray, counts_b: np.ndarray, values_b: np.ndarray, seed: int, draws: int) -> np.ndarray:
    """mean(b) - mean(a) of resamples. A resample of n draws from distinct values is one multinomial draw of their counts."""
    rng = np.random.default_rng(seed)

    def means(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
        n, step = int(counts.sum()), max(1, CELLS // len(counts))
        return np.concatenate([rng.multinomial(n, counts / n, size=min(step, draws - k)) @ values / n for k in range(0, draws, step)])

    return means(counts_b, values_b) - means(counts_a, values_a)


def places(iterations: int, level: float = CONFIDENCE) -> tuple[int, int]:
    """Where the ends of the interval are among sorted effects, from 0."""
    tail = (1 - level) / 2
    return int(np.floor(tail * (iterations - 1))), int(np.ceil((1 - tail) * (iterations - 1)))


def bootstrap_interval(counts_a: np.ndarray, values_a: np.ndarray, counts_b: np.ndarray, values_b: np.ndarray, seed: int, iterations: int = ITERATIONS, level: float = CONFIDENCE) -> tuple[float, float]:
    """Percentile interval of mean(b) - mean(a)."""
    effects = np.sort(resampled(counts_a, values_a, counts_b, values_b, seed, iterations))
    low, high = places(iterations, level)
    return float(effects[low]), float(effects[high])


def _seeded(*parts: object) -> np.random.Generator:
    import zlib

    return np.random.default_rng([zlib.crc32("\x1f".join(map(str, parts)).encode()), BOOTSTRAP_SEED])


def sums(rng: np.random.Generator, counts: np.ndarray, values: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Per entry of draws the sum of that many draws from values, each as likely as its count.

    A value that occurs often is drawn as a number of times, by a multinomial; to those that occur at most FEW times it gives one number
    for all, and so many are then picked one by one, which costs far less a value than a binomial each."""
    few = counts <= FEW
    picks = np.repeat(values[few], counts[few])
    cells = rng.multinomial(draws, np.append(counts[~few], len(picks)) / counts.sum())
    total, some = cells[:, :-1] @ values[~few], cells[:, -1]
    if len(picks):
        picked = np.append(picks[rng.integers(0, len(picks), some.sum(), dtype=np.uint32)], 0.0)
        total += np.where(some > 0, np.add.reduceat(picked, np.cumsum(some) - some), 0.0)
    return total


def _drawn(iterations: int):
    """The mean's share that a slice of values gives each resample.

    A resample draws how many of its n come from each band of slices, then from each slice of a band, then from each value of a slice: three
    draws, which together are one multinomial over all values. The first two are seeded by the group and the band alone, so every slice comes
    to the same numbers without being told them."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"segment": [], "metric": [], "variant": [], "draw": [], "part": []})
        one = right.iloc[0]
        name = (one["segment"], one["metric"], one["variant"])
        bands, in_bands = (np.array([x[k] for x in one["bands"]]) for k in ("band", "n"))
        slices, in_slices = (np.array([x[k] for x in one["slices"]]) for k in ("slice", "n"))
        left = left.sort_values("v")
        values, counts = left["v"].to_numpy(), left["n"].to_numpy()
        n = int(in_bands.sum())
        parts = []
        for block in range(0, iterations, DRAWS):
            m = min(DRAWS, iterations - block)
            some = _seeded(*name, block).multinomial(n, in_bands / n, size=m)[:, int(np.flatnonzero(bands == one["band"])[0])]
            some = _seeded(*name, block, one["band"]).multinomial(some, in_slices / in_slices.sum())[:, int(np.flatnonzero(slices == one["slice"])[0])]
            rng, step = _seeded(*name, block, one["band"], one["slice"]), max(1, CELLS // int(np.minimum(counts, FEW).sum()))
            parts += [sums(rng, counts, values, some[k : k + step]) / n for k in range(0, m, step)]
        return pd.DataFrame({"segment": name[0], "metric": name[1], "variant": name[2], "draw": np.arange(iterations), "part": np.concatenate(parts)})

    return run


def bootstrap(obs: DataFrame, iterations: int = ITERATIONS, values: int = VALUES) -> DataFrame:
    """(segment, metric, low, high), with a segment `all`; zeros where a variant has no values.

    Observations are counted by value; a group's distinct values are dealt by hash to slices of about `values`, and the slices to bands, as many as a band has slices. Each
    slice draws all resamples of its values by itself; its parts are summed by resample, in each task before the shuffle. No task has a segment.
    Slices are few bytes and much work, so they are dealt to tasks by their number, not by their size."""
    group = ["segment", "metric", "variant"]
    both = obs.filter("v is not null").withColumn("segment", F.explode(F.array("segment", F.lit("all"))))
    counted = stage(both.groupBy(*group, "v").agg(F.count("*").alias("n")), "counted")
    sizes = counted.groupBy(*group).agg(F.ceil(F.count("*") / values).alias("_s")).withColumn("_w", F.ceil(F.sqrt("_s")))
    dealt = counted.join(sizes, group).withColumn("slice", F.pmod(F.xxhash64("v"), "_s")).withColumn("band", F.expr("slice div _w")).drop("_s", "_w")
    dealt = stage(dealt, "dealt")
    slices = dealt.groupBy(*group, "band", "slice").agg(F.sum("n").alias("n"))
    bands = slices.groupBy(*group, "band").agg(F.sort_array(F.collect_list(F.struct("slice", "n"))).alias("slices"), F.sum("n").alias("n"))
    whole = bands.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("band", "n"))).alias("bands"))
    told = stage(slices.select(*group, "band", "slice").join(bands.drop("n"), [*group, "band"]).join(whole, group), "told")
    key = [*group, "slice"]
    tasks = max(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-told.count() // SLICES_A_TASK))
    drawn = dealt.repartition(tasks, *key).groupBy(*key).cogroup(told.repartition(tasks, *key).groupBy(*key)).applyInPandas(_drawn(iterations), "segment string, metric string, variant string, draw int, part double")
    side = lambda v: F.sum(F.when(F.col("variant") == v, F.col("part")))
    effects = drawn.groupBy("segment", "metric", "draw").agg(F.coalesce(side("treatment") - side("baseline"), F.lit(0.0)).alias("effect"))
    low, high = places(iterations)
    # a list holds `iterations` numbers
    ends = effects.groupBy("segment", "metric").agg(F.sort_array(F.collect_list("effect")).alias("effects"))
    return ends.select("segment", "metric", F.element_at("effects", low + 1).alias("low"), F.element_at("effects", high + 1).alias("high"))


@query("bootstrap_intervals")
def bootstrap_intervals(d: Domain) -> DataFrame:
    return bootstrap(observations(d))


def performance(rows: DataFrame) -> DataFrame:
    """Adds performance_pass to judged rows with intervals (low, high); directions turn effects so that higher is better."""
    of = lambda k: F.create_map(*(F.lit(x) for m, v in METRICS.items() for x in (m, v[k])))[F.col("metric")]
    way = of(1)
    rows = rows.withColumns({"role": of(0), "effect": F.col("effect") * way, "low": F.when(way > 0, F.col("low")).otherwise(-F.col("high")), "high": F.when(way > 0, F.col("high")).otherwise(-F.col("low"))})
    primary = (F.col("effect") >= of(2)) & (F.abs("size") >= LEAST_SIZE) & (F.col("low") > 0) & (F.col("adjusted") <= ALPHA)
    guard = (F.col("effect") >= -of(3)) & (F.col("low") >= -of(3))
    return rows.withColumn("performance_pass", F.col("sample_sufficient") & F.col("quality_pass") & F.when(F.col("role") == "PRIMARY", primary).otherwise(guard))


def gates(rows: DataFrame, out_of_window: int = 0, unassigned: int = 0, approved: bool = False) -> DataFrame:
    """(gate, status), the five gates in order, from the rows of `performance`. Few rows come together here: one per segment and metric."""
    severe = F.bool_or((F.col("segment") == "all") & (F.col("role") == "GUARDRAIL") & F.col("sample_sufficient") & F.col("quality_pass") & (F.col("effect") <= -ROLLBACK) & (F.col("high") < 0))
    one = rows.agg(
        (F.bool_and("quality_pass") & F.lit(out_of_window == 0 and unassigned == 0)).alias("quality"), F.bool_and("sample_sufficient").alias("sample"), F.bool_and("performance_pass").alias("performance"), severe.alias("severe")
    )
    status = lambda good, other: F.when(good, "PASS").otherwise(other)
    found = [
        ("CONTRACT_INTEGRITY", F.lit("PASS")), ("DATA_QUALITY", status(F.col("quality"), "FAIL")), ("SAMPLE_SUFFICIENCY", status(F.col("sample"), "HOLD")),
        ("PERFORMANCE_GUARDRAIL", F.when(F.col("severe"), "FAIL").otherwise(status(F.col("performance"), "HOLD"))), ("OPERATIONAL_APPROVAL", F.lit("PASS" if approved else "HOLD")),
    ]
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(n).alias("gate"), c.alias("status"), F.col("severe").alias("severe")) for k, (n, c) in enumerate(found)))))


def decision(gated: DataFrame, current: str, requested: str) -> DataFrame:
    """(decision, target): a severe regression of a released policy rolls back; all gates passed allow a step that the machine has; else hold."""
    one = gated.agg(F.bool_or("severe").alias("severe"), F.bool_and(F.col("status") == "PASS").alias("passed"))
    back = F.col("severe") & F.lit(current in ("CANARY", "LIVE"))
    go = F.col("passed") & F.lit(requested in STEPS[current])
    return one.select(
        F.when(back, "ROLLBACK").when(go, "LIVE" if requested == "LIVE" else "CANARY").otherwise("HOLD").alias("decision"),
        F.when(back, "ROLLED_BACK").when(go, requested).otherwise("HOLD" if "HOLD" in STEPS[current] else current).alias("target"),
    )


def evaluated(d: Domain) -> DataFrame:
    obs = observations(d)
    return performance(judged(holm(effect_columns(obs))).join(bootstrap(obs), ["segment", "metric"]))


@query("experiment_gates")
def experiment_gates(d: Domain) -> DataFrame:
    audit = exposure_audit(d).first()
    return gates(evaluated(d), audit["out_of_window"], audit["unassigned"], approved=True).drop("severe")


@query("experiment_decision")
def experiment_decision(d: Domain) -> DataFrame:
    audit = exposure_audit(d).first()
    return decision(gates(evaluated(d), audit["out_of_window"], audit["unassigned"], approved=True), "CANARY", "LIVE")


def run_candidates(d: Domain) -> DataFrame:
    """Candidates per region as a run: newest first, with their diversity keys."""
    w = Window.partitionBy("region_id").orderBy(F.desc_nulls_last("published_at"), "post_id")
    return d.posts.filter("status = 'PUBLISHED'").select(
        F.col("region_id").cast("long").alias("run_id"), "post_id", F.row_number().over(w).alias("base_rank"),
        F.col("title").alias("duplicate_group"), F.expr("cast(post_id div 25 % 40 as string)").alias("author_id"), F.col("brand").alias("region_id"), "theme",
    )


@query("diversity_rerank")
def diversity_rerank(d: Domain) -> DataFrame:
    return rerank.rerank(run_candidates(d))


@query("diversity_rerank_forced_fit")
def diversity_rerank_forced_fit(d: Domain) -> DataFrame:
    """The second policy, for the home feed."""
    window, promotion, demotion, caps = SURFACES["home_feed"]
    return rerank.rerank(run_candidates(d), rerank.Diversity(window=window, caps=caps, promotion=promotion, demotion=demotion), forced_must_fit=True)


@query("exploration_insertion")
def exploration_insertion(d: Domain) -> DataFrame:
    """Rank, diversify, explore: drafts are the pool."""
    ranked = rerank.rerank(run_candidates(d)).join(run_candidates(d).drop("base_rank"), ["run_id", "post_id"])
    w = Window.partitionBy("region_id").orderBy("price", "post_id")
    pool = d.posts.filter("status = 'DRAFT'").select(
        F.col("region_id").cast("long").alias("run_id"), "post_id", F.row_number().over(w).alias("place"),
        F.col("title").alias("duplicate_group"), F.expr("cast(post_id div 25 % 40 as string)").alias("author_id"), F.col("brand").alias("region_id"), "theme",
    ).filter(F.col("place") <= rerank.MOST)
    return rerank.insert_exploration(ranked, pool)
