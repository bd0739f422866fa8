"""Pages of a stored ranking: cursors bound to a snapshot's content, its policies, a rank and an end of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fingerprint import fold, row_hash, row_text, sql_fold, sql_text
from ..sources.sinks import stage
from ..sources.tables import NOW, Domain, now
from .registry import query
from .scoring import _CANDIDATES, TYPES, candidates

# Versions that a cursor names, its life, the largest page.
VERSION, RANKING_POLICY, SCORE_POLICY, LIFE_MS, HARD_PAGE = "v3", "ranking-v1", "score-composition-v1", 5 * 60_000, 30
#: Why a cursor is refused, in the order it is looked at.
REFUSALS = ("CURSOR_MALFORMED", "CURSOR_SNAPSHOT_MISMATCH", "CURSOR_RANKING_POLICY_MISMATCH", "CURSOR_SCORE_POLICY_MISMATCH", "CURSOR_EXPIRED", "CURSOR_RANK_OUTSIDE", "CURSOR_IDENTITY_MISMATCH")
FIELDS = ("version", "snapshot", "ranking_policy", "score_policy", "rank", "type", "id", "expires")


def cursor(snapshot: Column, rank: Column, type_: Column, id_: Column, expires: Column, ranking: Column | None = None, score: Column | None = None) -> Column:
    """URL-safe Base64 without padding. A null end is a cursor that doesn't expire (v2)."""
    version = F.when(expires.isNull(), "v2").otherwise(VERSION)
    parts = (version, snapshot, F.lit(RANKING_POLICY) if ranking is None else ranking, F.lit(SCORE_POLICY) if score is None else score, rank.cast("string"), type_, id_.cast("string"), F.coalesce(expires.cast("string"), F.lit("")))
    # base64 breaks long lines; translate leaves out what has no counterpart
    return F.rtrim(F.translate(F.base64(F.encode(F.concat_ws("|", *parts), "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def decoded(text: Column) -> Column:
    """A struct of FIELDS as texts, or null where the cursor isn't one."""
    plain = F.translate(text, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    parts = F.split(F.try_to_binary(padded, F.lit("base64")).cast("string"), r"\|")
    known = (F.size(parts) == len(FIELDS)) & parts[0].isin("v2", VERSION) & parts[4].try_cast("int").isNotNull() & ((parts[0] == "v2") == (parts[7] == ""))
    return F.when(known, F.struct(*(parts[i].alias(n) for i, n in enumerate(FIELDS))))


def stored(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (user_id, post_id, type, score, filled): the ranked items (user_id, rank, post_id, type, scaled), and per user (snapshot, total),
    where snapshot is a fingerprint of the items. A user has as many candidates as are scored at once, so users are what is dealt."""
    type_rank = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type"))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), "filled", type_rank, "post_id")
    items = rows.select("user_id", F.row_number().over(w).alias("rank"), "post_id", "type", F.round(F.col("score") * 1_000_000_000).cast("long").alias("scaled"))
    items = stage(items, "ranking")
    heads = items.groupBy("user_id").agg(fold(row_hash(row_text("rank", "post_id", "type", "scaled"))).alias("snapshot"), F.count("*").alias("total"))
    return items, heads


def pages(items: DataFrame, heads: DataFrame, requests: DataFrame) -> DataFrame:
    """A row per item of each request's page, or one row with its refusal (or with neither, where nothing follows).

    requests: request, user_id, cursor (null: the first page), size, at (a time). Ranks are whole numbers, so a page is looked up by (user, rank), not searched."""
    r = requests.withColumn("c", decoded(F.col("cursor"))).join(heads, "user_id", "left")
    edge = items.select("user_id", F.col("rank").alias("edge"), F.col("type").alias("edge_type"), F.col("post_id").alias("edge_id"))
    c = lambda n: F.col(f"c.{n}")
    r = r.withColumn("edge", c("rank").try_cast("int")).join(edge, ["user_id", "edge"], "left")
    given = F.col("cursor").isNotNull()
    tests = (
        F.col("c").isNull(), ~c("snapshot").eqNullSafe(F.col("snapshot")), c("ranking_policy") != RANKING_POLICY, c("score_policy") != SCORE_POLICY,
        (c("version") == VERSION) & (F.unix_millis("at") >= F.coalesce(c("expires").try_cast("long"), F.lit(0))), F.col("edge_id").isNull(), (F.col("edge_type") != c("type")) | (F.col("edge_id").cast("string") != c("id")),
    )
    refusal = F.when(F.lit(False), "")
    for test, name in zip(tests, REFUSALS, strict=True):
        refusal = refusal.when(given & test, name)
    start, size = F.when(given, F.col("edge")).otherwise(0), F.least(F.greatest("size", F.lit(1)), F.lit(HARD_PAGE))
    r = r.select("request", "user_id", "snapshot", F.coalesce("total", F.lit(0)).alias("total"), "at", refusal.alias("refusal"), start.alias("start"), size.alias("size"))
    last = F.least(F.col("start") + F.col("size"), F.col("total")).cast("int")
    served = r.filter(F.col("refusal").isNull() & (last > F.col("start"))).withColumn("last", last).withColumn("rank", F.explode(F.sequence(F.col("start") + 1, F.col("last"))))
    served = served.join(items, ["user_id", "rank"])
    more = (F.col("rank") == F.col("last")) & (F.col("last") < F.col("total"))
    following = F.when(more, cursor(F.col("snapshot"), F.col("rank"), F.col("type"), F.col("post_id"), F.unix_millis("at") + LIFE_MS))
    none = r.filter(F.col("refusal").isNotNull() | (last <= F.col("start"))).select("request", "user_id", "refusal")
    return served.select("request", "user_id", F.lit(None).cast("string").alias("refusal"), "rank", "post_id", following.alias("following")).unionByName(none, allowMissingColumns=True)


#: Nine requests a member: the first page, a cursor at rank 2 as it must be, one without an end, and one for each refusal.
_SNAPSHOT = f"""{_CANDIDATES}, items AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, filled, list_position(['POST', 'JOURNEY', 'PLACE', 'CREW'], type), post_id) AS rank, post_id, type, round(score * 1000000000)::BIGINT AS scaled
        FROM (SELECT user_id, post_id, type, round(least(1.0, greatest(0.0, raw)), 9) AS score, round(filled, 6) AS filled FROM result WHERE status = 'SCORED')),
    heads AS (SELECT user_id, {sql_fold(sql_text('rank', 'post_id', 'type', 'scaled'))} AS snapshot, count(*) AS total FROM items GROUP BY 1)"""
_B64 = lambda x: f"rtrim(replace(replace(base64(encode({x})), '+', '-'), '/', '_'), '=')"
_MS = f"epoch_ms(TIMESTAMP '{NOW}')"


def requests(items: DataFrame, heads: DataFrame) -> DataFrame:
    at2 = items.filter("rank = 2").select("user_id", "post_id", "type")
    rows = heads.join(at2, "user_id", "left").withColumn("kind", F.explode(F.sequence(F.lit(0), F.lit(8))))
    k, s, t, i = F.col("kind"), F.col("snapshot"), F.coalesce("type", F.lit("POST")), F.coalesce("post_id", F.lit(0))
    end = F.unix_millis(now()) + 1000
    make = lambda s=s, rank=F.lit(2), i=i, end=end, **more: cursor(s, rank, t, i, end, **more)
    c = (
        F.when(k == 1, make()).when(k == 2, make(end=F.lit(None).cast("long"))).when(k == 3, "not a cursor!").when(k == 4, make(s=F.lit("0:0:0"))).when(k == 5, make(ranking=F.lit("ranking-v0")))
        .when(k == 6, make(score=F.lit("score-v0"))).when(k == 7, make(end=end - 1000)).when(k == 8, F.when(F.col("user_id") % 2 == 0, make(rank=F.lit(9999))).otherwise(make(i=i + 1)))
    )
    return rows.select((F.col("user_id") * 10 + k).alias("request"), "user_id", c.alias("cursor"), F.lit(5).alias("size"), now().alias("at"))


@query(
    "snapshot_pages",
    f"""WITH {_SNAPSHOT}, asked AS (SELECT h.*, i.post_id AS id2, k FROM heads h LEFT JOIN items i ON i.user_id = h.user_id AND i.rank = 2, (SELECT unnest(range(9)) AS k)),
    r AS (SELECT user_id * 10 + k AS request, user_id, snapshot, total, k, CASE WHEN k = 0 THEN 0 ELSE 2 END AS start, CASE k WHEN 3 THEN 'CURSOR_MALFORMED' WHEN 4 THEN 'CURSOR_SNAPSHOT_MISMATCH' WHEN 5 THEN 'CURSOR_RANKING_POLICY_MISMATCH' WHEN 6 THEN 'CURSOR_SCORE_POLICY_MISMATCH' WHEN 7 THEN 'CURSOR_EXPIRED'
        WHEN 8 THEN CASE WHEN user_id % 2 = 0 OR id2 IS NULL THEN 'CURSOR_RANK_OUTSIDE' ELSE 'CURSOR_IDENTITY_MISMATCH' END ELSE CASE WHEN k > 0 AND id2 IS NULL THEN 'CURSOR_RANK_OUTSIDE' END END AS refusal FROM asked)
    SELECT r.request, r.user_id, NULL AS refusal, i.rank, i.post_id, CASE WHEN i.rank = least(start + 5, total) AND i.rank < total THEN {_B64(f"'v3|' || snapshot || '|ranking-v1|score-composition-v1|' || i.rank || '|' || i.type || '|' || i.post_id || '|' || ({_MS} + 300000)")} END AS following
    FROM r JOIN items i ON i.user_id = r.user_id AND i.rank > start AND i.rank <= start + 5 WHERE refusal IS NULL UNION ALL SELECT request, user_id, refusal, NULL, NULL, NULL FROM r WHERE refusal IS NOT NULL OR start >= total""",
    ("behaviour", "posts"),
)
def snapshot_pages(d: Domain) -> DataFrame:
    """Pages of members' rankings for cursors of every kind."""
    items, heads = stored(candidates(d).filter("status = 'SCORED'"))
    return pages(items, heads, requests(items, heads))
