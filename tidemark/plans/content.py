"""Feeds, searches, lists, graph and reporting queries over posts, members and their behaviour."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stage
from ..sources.tables import NOW, PUBLIC_SQL, Domain, now, public_posts
from .registry import query

PAGE = 20
_FEED = f"SELECT post_id, title, author_name, published_at FROM ({PUBLIC_SQL})"


def _newest() -> tuple[Column, Column]:
    return F.desc_nulls_last("published_at"), F.desc("post_id")


@query("feed_first_page", f"{_FEED} ORDER BY published_at DESC NULLS LAST, post_id DESC LIMIT {PAGE}", ("members", "posts"))
def feed_first_page(d: Domain) -> DataFrame:
    return public_posts(d.posts, d.members).orderBy(*_newest()).limit(PAGE).select("post_id", "title", "author_name", "published_at")


@query(
    "feed_two_stage_topk",
    f"""WITH newest AS (SELECT post_id FROM ({PUBLIC_SQL}) ORDER BY published_at DESC NULLS LAST, post_id DESC LIMIT 100),
    l AS (SELECT post_id, count(*) AS likes FROM likes GROUP BY post_id), s AS (SELECT post_id, count(*) AS saves FROM saves GROUP BY post_id)
    SELECT post_id, coalesce(likes, 0) + 2 * coalesce(saves, 0) AS popularity FROM newest LEFT JOIN l USING (post_id) LEFT JOIN s USING (post_id)
    ORDER BY popularity DESC, post_id LIMIT {PAGE}""",
    ("members", "posts", "likes", "saves"),
)
def feed_two_stage_topk(d: Domain) -> DataFrame:
    """The newest 100, then the most popular of them; behaviour meets these 100 ids before anything is counted."""
    newest = F.broadcast(public_posts(d.posts, d.members).orderBy(*_newest()).limit(100).select("post_id"))
    each = _member_flags(d.behaviour.join(newest, "post_id", "left_semi")).groupBy("post_id").agg(*_likes_saves())
    rows = newest.join(each, "post_id", "left")
    return rows.select("post_id", (F.coalesce("likes", F.lit(0)) + 2 * F.coalesce("saves", F.lit(0))).alias("popularity")).orderBy(F.desc("popularity"), "post_id").limit(PAGE)


def _member_flags(behaviour: DataFrame) -> DataFrame:
    """Per post and member: whether the member likes and saves it, views, reports and the last report; one pass, folded before the shuffle."""
    of = lambda k: F.col("kind") == k
    return behaviour.groupBy("post_id", "user_id").agg(
        F.bool_or(of("click")).alias("liked"), F.bool_or(of("save")).alias("saved"), F.count_if(of("view")).alias("v"), F.count_if(of("report")).alias("r"), F.max(F.when(of("report"), F.col("ts"))).alias("last")
    )


def _likes_saves() -> list:
    return [F.count_if("liked").alias("likes"), F.count_if("saved").alias("saves")]


def _counted(edges: DataFrame, name: str) -> DataFrame:
    return edges.groupBy("post_id").agg(F.count("*").alias(name))


@query(
    "feed_visible_to_viewer",
    """SELECT post_id, author_id, visibility FROM posts WHERE status = 'PUBLISHED' AND NOT hidden AND
    (visibility = 'PUBLIC' OR author_id = 7 OR author_id IN (SELECT followed_id FROM follows WHERE follower_id = 7))""",
    ("posts", "follows"),
)
def feed_visible_to_viewer(d: Domain, viewer: int = 7) -> DataFrame:
    """Public posts, the viewer's own, and followers' posts of those the viewer follows."""
    followed = d.follows.filter(F.col("follower_id") == viewer).select(F.col("followed_id").alias("author_id"), F.lit(True).alias("follows")).distinct()
    seen = (F.col("visibility") == "PUBLIC") | (F.col("author_id") == viewer) | F.coalesce("follows", F.lit(False))
    return d.posts.filter("status = 'PUBLISHED' and not hidden").join(followed, "author_id", "left").filter(seen).select("post_id", "author_id", "visibility")


@query(
    "post_search_contains",
    f"SELECT post_id, title, author_name FROM ({PUBLIC_SQL}) WHERE lower(title) LIKE '%ri%' OR lower(brand) LIKE '%ri%' OR lower(theme) LIKE '%ri%' OR lower(author_name) LIKE '%ri%'",
    ("members", "posts"),
)
def post_search_contains(d: Domain, text: str = "Ri") -> DataFrame:
    """Case-insensitive containment in any of several columns; % and _ in the text stay wildcards."""
    pattern = f"%{text.lower()}%"
    hit = F.lit(False)
    for c in ("title", "brand", "theme", "author_name"):
        hit = hit | F.lower(c).like(pattern)
    return public_posts(d.posts, d.members).filter(hit).select("post_id", "title", "author_name")


@query(
    "admin_search",
    "SELECT user_id, username, active FROM members WHERE position('17' IN lower(username)) > 0 OR user_id = 17 ORDER BY user_id LIMIT 50",
    ("members",),
)
def admin_search(d: Domain, text: str = "17") -> DataFrame:
    """Substring by position; a text that is a number also finds that id."""
    hit = F.instr(F.lower("username"), text.lower()) > 0
    if text.strip().lstrip("-").isdigit():
        hit = hit | (F.col("user_id") == int(text))
    return d.members.filter(hit).orderBy("user_id").limit(50).select("user_id", "username", "active")


@query(
    "member_filter_optional",
    "SELECT user_id, segment, nation FROM members WHERE segment = 'BUILDING' AND active",
    ("members",),
)
def member_filter_optional(d: Domain, segment: str | None = "BUILDING", nation: int | None = None, active: bool | None = True) -> DataFrame:
    """Parameters that are None don't restrict."""
    rows = d.members
    for c, v in (("segment", segment), ("nation", nation), ("active", active)):
        if v is not None:
            rows = rows.filter(F.col(c) == F.lit(v))
    return rows.select("user_id", "segment", "nation")


@query(
    "posts_with_active_place",
    """SELECT post_id FROM posts p WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p.post_id AND s_acctbal >= 5000)""",
    ("posts",),
)
def posts_with_active_place(d: Domain) -> DataFrame:
    places = d.table("supplier").filter("s_acctbal >= 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    links = d.table("lineitem").join(places, "l_suppkey", "left_semi").select(F.col("l_partkey").alias("post_id"))
    return d.posts.join(links, "post_id", "left_semi").select("post_id")


@query(
    "posts_without_behaviour",
    "SELECT post_id FROM posts p WHERE NOT EXISTS (SELECT 1 FROM behaviour b WHERE b.post_id = p.post_id)",
    ("posts", "behaviour"),
)
def posts_without_behaviour(d: Domain) -> DataFrame:
    return d.posts.join(d.behaviour.select("post_id"), "post_id", "left_anti").select("post_id")


EARTH_KM = 6371.0088
_LAT, _LON = "(n_nationkey * 7 % 31 + 30)", "(n_nationkey * 11 % 43 + 100)"


@query(
    "regions_nearby",
    f"""WITH p AS (SELECT n_nationkey AS id, n_name AS name, {_LAT}::DOUBLE AS lat, {_LON}::DOUBLE AS lon FROM nation),
    x AS (SELECT id, name, round(2 * {EARTH_KM} * asin(sqrt(least(1.0, power(sin(radians(lat - 37.5) / 2), 2)
        + cos(radians(37.5)) * cos(radians(lat)) * power(sin(radians(lon - 127.0) / 2), 2)))), 6) AS km FROM p)
    SELECT id, name, km FROM x WHERE km <= 500 ORDER BY km, id LIMIT 100""",
)
def regions_nearby(d: Domain, lat: float = 37.5, lon: float = 127.0, radius: float = 500.0, limit: int = 100) -> DataFrame:
    """Great-circle distance by the haversine formula."""
    if not 0 < radius <= 500 or not 1 <= limit <= 100:
        raise ValueError("radius must be in (0, 500] and limit in 1..100")
    p = d.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.expr(_LAT).cast("double").alias("lat"), F.expr(_LON).cast("double").alias("lon"))
    half = lambda c, v: F.pow(F.sin(F.radians(F.col(c) - v) / 2), 2)
    h = half("lat", lat) + F.cos(F.radians(F.lit(lat))) * F.cos(F.radians("lat")) * half("lon", lon)
    rows = p.withColumn("km", F.round(2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h))), 6)).filter(F.col("km") <= radius)
    return rows.orderBy("km", "id").limit(limit).select("id", "name", "km")


TERMS = ("the", "thand", "inhe", "ereder")


@query(
    "search_overlap",
    f"""WITH t AS (SELECT doc_id, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+')), lambda x: x <> '') AS terms FROM documents WHERE lang = 'en')
    SELECT doc_id, len(list_intersect(terms, {list(TERMS)}))::INTEGER AS hits FROM t WHERE list_has_any(terms, {list(TERMS)})""",
)
def search_overlap(d: Domain) -> DataFrame:
    """Documents whose terms overlap with the query's."""
    terms = F.filter(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+")), lambda x: x != "")
    wanted = F.array(*map(F.lit, TERMS))
    rows = d.table("documents").filter("lang = 'en'").select("doc_id", terms.alias("terms"))
    return rows.filter(F.arrays_overlap("terms", wanted)).select("doc_id", F.size(F.array_intersect("terms", wanted)).alias("hits"))


@query(
    "search_staleness",
    f"""SELECT theme, count(*) AS matching, count(*) FILTER (WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY) AS fresh,
    CASE WHEN count(*) = 0 THEN 'EMPTY' WHEN count(*) FILTER (WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY) = 0 THEN 'STALE' ELSE 'OK' END AS status FROM posts GROUP BY theme""",
    ("posts",),
)
def search_staleness(d: Domain) -> DataFrame:
    fresh = F.count_if(F.col("published_at") >= now() - F.expr("interval 14 days"))
    rows = d.posts.groupBy("theme").agg(F.count("*").alias("matching"), fresh.alias("fresh"))
    return rows.withColumn("status", F.when(F.col("matching") == 0, "EMPTY").when(F.col("fresh") == 0, "STALE").otherwise("OK"))


@query(
    "format_checks",
    "SELECT user_id, regexp_matches(username, '^[A-Za-z#0-9]{3,30}$') AS username_ok, regexp_matches(lower(segment), '^[a-z0-9]+(-[a-z0-9]+)*$') AS slug_ok, regexp_matches(upper(substr(segment, 1, 2)), '^[A-Z]{2}$') AS country_ok FROM members",
    ("members",),
)
def format_checks(d: Domain) -> DataFrame:
    return d.members.select(
        "user_id",
        F.col("username").rlike("^[A-Za-z#0-9]{3,30}$").alias("username_ok"),
        F.lower("segment").rlike("^[a-z0-9]+(-[a-z0-9]+)*$").alias("slug_ok"),
        F.upper(F.substring("segment", 1, 2)).rlike("^[A-Z]{2}$").alias("country_ok"),
    )


@query(
    "search_eligibility",
    """SELECT p.post_id, CASE WHEN m.user_id IS NULL THEN 'AUTHOR_MISSING' WHEN NOT m.active THEN 'AUTHOR_INACTIVE' WHEN status <> 'PUBLISHED' THEN 'NOT_PUBLISHED'
    WHEN hidden THEN 'HIDDEN' WHEN visibility <> 'PUBLIC' THEN 'NOT_PUBLIC' WHEN published_at IS NULL THEN 'NO_TIME' ELSE 'ELIGIBLE' END AS decision
    FROM posts p LEFT JOIN members m ON m.user_id = p.author_id""",
    ("posts", "members"),
)
def search_eligibility(d: Domain) -> DataFrame:
    """The first reason that denies decides."""
    authors = d.members.select(F.col("user_id").alias("author_id"), "active")
    first = (
        F.when(F.col("active").isNull(), "AUTHOR_MISSING").when(~F.col("active"), "AUTHOR_INACTIVE").when(F.col("status") != "PUBLISHED", "NOT_PUBLISHED")
        .when(F.col("hidden"), "HIDDEN").when(F.col("visibility") != "PUBLIC", "NOT_PUBLIC").when(F.col("published_at").isNull(), "NO_TIME").otherwise("ELIGIBLE")
    )
    return d.posts.join(authors, "author_id", "left").select("post_id", first.alias("decision"))


@query(
    "post_counts",
    """WITH l AS (SELECT post_id, count(*) AS likes FROM likes GROUP BY 1), s AS (SELECT post_id, count(*) AS saves FROM saves GROUP BY 1),
    v AS (SELECT post_id, count(*) AS views FROM behaviour WHERE kind = 'view' GROUP BY 1), r AS (SELECT post_id, count(*) AS reports, max(ts) AS last_report FROM behaviour WHERE kind = 'report' GROUP BY 1)
    SELECT p.post_id, coalesce(likes, 0) AS likes, coalesce(saves, 0) AS saves, coalesce(views, 0) AS views, coalesce(reports, 0) AS reports, last_report
    FROM posts p LEFT JOIN l USING (post_id) LEFT JOIN s USING (post_id) LEFT JOIN v USING (post_id) LEFT JOIN r USING (post_id)""",
    ("posts", "likes", "saves"),
)
def post_counts(d: Domain) -> DataFrame:
    """Counts are taken before the join, so posts without any stay with 0; behaviour is read once, and folded by member before it is counted."""
    each = _member_flags(d.behaviour).groupBy("post_id").agg(*_likes_saves(), F.sum("v").alias("views"), F.sum("r").alias("reports"), F.max("last").alias("last_report"))
    return d.posts.select("post_id").join(each, "post_id", "left").fillna(0, ["likes", "saves", "views", "reports"])


@query(
    "dashboard",
    f"""SELECT (SELECT count(*) FROM members) AS members, (SELECT count(*) FROM members WHERE active) AS active_members, (SELECT count(*) FROM posts) AS posts,
    (SELECT count(*) FROM posts WHERE status = 'PUBLISHED') AS published, (SELECT count(*) FROM posts WHERE hidden) AS hidden_posts,
    (SELECT count(*) FROM behaviour WHERE kind = 'report' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS reports_7d""",
    ("members", "posts", "behaviour"),
)
def dashboard(d: Domain) -> DataFrame:
    """One row; each table is read once."""
    m = d.members.agg(F.count("*").alias("members"), F.count_if("active").alias("active_members"))
    p = d.posts.agg(F.count("*").alias("posts"), F.count_if(F.col("status") == "PUBLISHED").alias("published"), F.count_if("hidden").alias("hidden_posts"))
    b = d.behaviour.filter("kind = 'report'").agg(F.count_if(F.col("ts") >= now() - F.expr("interval 7 days")).alias("reports_7d"))
    one = F.lit(1).alias("one")
    return m.select("*", one).join(p.select("*", one), "one").join(b.select("*", one), "one").drop("one")


@query(
    "state_counts",
    """SELECT theme, count(*) FILTER (WHERE status = 'PUBLISHED') AS published, count(*) FILTER (WHERE status = 'DRAFT') AS draft, count(DISTINCT author_id) AS authors,
    count(DISTINCT author_id) FILTER (WHERE hidden) AS hidden_authors, max(price) AS dearest FROM posts GROUP BY theme""",
    ("posts",),
)
def state_counts(d: Domain) -> DataFrame:
    return d.posts.groupBy("theme").agg(
        F.count_if(F.col("status") == "PUBLISHED").alias("published"), F.count_if(F.col("status") == "DRAFT").alias("draft"),
        F.countDistinct("author_id").alias("authors"), F.countDistinct(F.when(F.col("hidden"), F.col("author_id"))).alias("hidden_authors"), F.max("price").alias("dearest"),
    )


@query(
    "publish_lag",
    f"""SELECT brand, round(avg(date_diff('second', published_at, TIMESTAMP '{NOW}')) FILTER (WHERE status = 'PUBLISHED'), 6) AS mean_lag,
    max(date_diff('second', published_at, TIMESTAMP '{NOW}'))::BIGINT AS longest_lag FROM posts GROUP BY brand""",
    ("posts",),
)
def publish_lag(d: Domain) -> DataFrame:
    lag = F.timestamp_diff("SECOND", F.col("published_at"), now())
    return d.posts.groupBy("brand").agg(F.round(F.avg(F.when(F.col("status") == "PUBLISHED", lag)), 6).alias("mean_lag"), F.max(lag).alias("longest_lag"))


@query(
    "repeated_reports",
    "SELECT post_id, count(*) AS reporters, sum(n)::BIGINT AS reports FROM (SELECT post_id, user_id, count(*) AS n FROM behaviour WHERE kind = 'report' GROUP BY 1, 2) GROUP BY post_id HAVING count(*) >= 3",
    ("behaviour",),
)
def repeated_reports(d: Domain) -> DataFrame:
    """Counted per member, then per post, then filtered."""
    per_member = d.behaviour.filter("kind = 'report'").groupBy("post_id", "user_id").agg(F.count("*").alias("n"))
    return per_member.groupBy("post_id").agg(F.count("*").alias("reporters"), F.sum("n").alias("reports")).filter("reporters >= 3")


@query(
    "region_post_lists",
    """SELECT region_id, string_agg(title, ',' ORDER BY title, post_id) AS titles, min(post_id) AS first_post FROM posts GROUP BY region_id""",
    ("posts",),
)
def region_post_lists(d: Domain) -> DataFrame:
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "post_id"))), lambda x: x["title"]), ",")
    return d.posts.groupBy("region_id").agg(titles.alias("titles"), F.min("post_id").alias("first_post"))


@query(
    "first_seen_posts",
    """WITH f AS (SELECT user_id, post_id, min(ts) AS t FROM behaviour WHERE kind = 'view' GROUP BY 1, 2)
    SELECT user_id, string_agg(post_id::VARCHAR, ',' ORDER BY t, post_id) AS posts FROM f GROUP BY user_id""",
    ("behaviour",),
)
def first_seen_posts(d: Domain) -> DataFrame:
    """Distinct values in the order they first occur."""
    first = d.behaviour.filter("kind = 'view'").groupBy("user_id", "post_id").agg(F.min("ts").alias("t"))
    posts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "post_id"))), lambda x: x["post_id"].cast("string")), ",")
    return first.groupBy("user_id").agg(posts.alias("posts"))


@query(
    "order_place_first",
    "SELECT post_id, flag, min(place_id) AS place_id, count(*) AS n FROM runs GROUP BY post_id, flag",
    ("runs",),
)
def order_place_first(d: Domain) -> DataFrame:
    return d.runs.groupBy("post_id", "flag").agg(F.min("place_id").alias("place_id"), F.count("*").alias("n"))


_METRICS = {
    "events": "count(*)",
    "users": "count(DISTINCT user_id)",
    "posts": "count(DISTINCT post_id)",
    "views": "count(CASE WHEN kind = 'view' THEN 1 END)",
    "reports": "count(CASE WHEN kind = 'report' THEN 1 END)",
    "missing_value": "count(CASE WHEN value IS NULL THEN 1 END)",
}


@query(
    "metrics_long",
    " UNION ALL ".join(f"SELECT '{k}' AS metric, CAST({v} AS BIGINT) AS n FROM behaviour" for k, v in _METRICS.items()),
    ("behaviour",),
)
def metrics_long(d: Domain) -> DataFrame:
    """Several aggregates of one table as rows: one pass, then turned."""
    wide = d.behaviour.agg(*(F.expr(v).cast("long").alias(k) for k, v in _METRICS.items()))
    return wide.unpivot([], list(_METRICS), "metric", "n")


@query(
    "report_reasons",
    "SELECT CASE WHEN value < 10 THEN 'minor' WHEN value < 100 THEN 'usual' ELSE 'grave' END AS reason, count(*) AS n, count(DISTINCT user_id) AS members FROM behaviour WHERE kind = 'report' GROUP BY 1",
    ("behaviour",),
)
def report_reasons(d: Domain) -> DataFrame:
    reason = F.when(F.col("value") < 10, "minor").when(F.col("value") < 100, "usual").otherwise("grave")
    return d.behaviour.filter("kind = 'report'").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("members"))


@query(
    "latency_p95",
    "SELECT kind, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM behaviour GROUP BY kind",
    ("behaviour",),
)
def latency_p95(d: Domain) -> DataFrame:
    """Nearest rank: an observed value, without interpolation."""
    return nearest_rank(d.behaviour, "kind", "value", 0.95, "p95")


#: Distinct values of a group that one task may rank; slices that a group's values are cut into.
FEW, SLICES = 4_096, 64


def nearest_rank(rows: DataFrame, group: str, value: str, q: float, name: str, few: int = FEW, slices: int = SLICES) -> DataFrame:
    """(group, name, n): the value at rank ceil(q * n), exactly; null for a group without values.

    Equal values are counted first. Then, round by round, the values a group still has are cut at ends that come from them (approximate
    quantiles of the distinct values, whose sketches are folded in each task), the slice with the rank is kept, and what lies below it is counted, until a
    group has `few` distinct values. However values are spread, a round leaves about one in `slices` of them, so rounds are few, and no task gets a group."""
    key = lambda df: df.select(F.col(group).alias("_g"), *(c for c in df.columns if c != group))
    ends = rows.groupBy(group).agg(F.count(value).alias("_n"), F.count("*").alias("n"))
    left = stage(key(rows.filter(F.col(value).isNotNull()).select(group, F.col(value).alias("_v")).groupBy(group, "_v").agg(F.count("*").alias("_c"))), "values")
    goal = stage(key(ends).select("_g", "n", F.greatest(F.lit(1), F.ceil(F.col("_n") * q)).cast("long").alias("_rank")), "ranks")
    while True:
        held = left.groupBy("_g").agg(F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        wide = held.filter(F.col("_d") > few)
        if not wide.limit(1).count():
            break
        cuts = stage(left.join(wide.select("_g"), "_g", "left_semi").groupBy("_g").agg(F.approx_percentile("_v", [k / slices for k in range(1, slices)], 100 * slices).alias("_cuts")), "cuts")
        part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(0))
        dealt = _beside(left, cuts, "left").withColumn("_part", part)
        before = F.sum("_c").over(Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
        sums = dealt.groupBy("_g", "_part").agg(F.sum("_c").alias("_c")).withColumn("_b", before)
        hit = _beside(sums, goal, "inner").filter((F.col("_b") < F.col("_rank")) & (F.col("_rank") <= F.col("_b") + F.col("_c")))
        hit = stage(hit.select("_g", "n", (F.col("_rank") - F.col("_b")).alias("_rank"), F.col("_part").alias("_at")), "slice")
        left = stage(_beside(dealt, hit.select("_g", "_at"), "inner").filter("_part = _at").select("_g", "_v", "_c"), "values")
        goal = goal.join(hit.select(F.col("_g").alias("_h")), F.col("_g").eqNullSafe(F.col("_h")), "left_anti").unionByName(hit.select("_g", "n", "_rank"))
    upto = F.sum("_c").over(Window.partitionBy("_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = _beside(left.withColumn("_s", upto), goal, "inner").filter(F.col("_s") >= F.col("_rank")).groupBy("_g").agg(F.min("_v").alias("_v"))
    return _beside(goal, found, "left").select(F.col("_g").alias(group), F.col("_v").alias(name), "n")


def _beside(rows: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """rows with what there is of their group, null being a group. There is one row of `groups` a group, so hot groups are met by broadcast where the
    optimizer sees that it is small, and split where a shuffle is skewed."""
    return rows.join(groups.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h")), how).drop("_h")


@query(
    "region_descendants",
    """WITH RECURSIVE t AS (SELECT region_id, parent_id, slug, 0 AS depth, [region_id] AS path FROM regions WHERE parent_id IS NULL
    UNION ALL SELECT r.region_id, r.parent_id, r.slug, t.depth + 1, list_append(t.path, r.region_id) FROM regions r JOIN t ON r.parent_id = t.region_id WHERE NOT list_contains(t.path, r.region_id))
    SELECT region_id, slug, depth::INTEGER AS depth, path[1] AS root FROM t""",
    ("regions",),
)
def region_descendants(d: Domain) -> DataFrame:
    return descendants(d.regions)


def _recursive(nodes: DataFrame, sql: str) -> DataFrame:
    """The SQL over a view of nodes that goes when the plan is made."""
    name = f"nodes_{uuid.uuid4().hex}"
    nodes.createOrReplaceTempView(name)
    try:
        return nodes.sparkSession.sql(sql.format(nodes=name))
    finally:
        nodes.sparkSession.catalog.dropTempView(name)


def descendants(nodes: DataFrame) -> DataFrame:
    """All nodes under the roots with depth and root; a node already on its path ends it there, so cycles end."""
    return _recursive(
        nodes,
        """WITH RECURSIVE t AS (
            SELECT region_id, slug, 0 AS depth, region_id AS root, array(region_id) AS path FROM {nodes} WHERE parent_id IS NULL
            UNION ALL
            SELECT r.region_id, r.slug, t.depth + 1, t.root, array_append(t.path, r.region_id)
            FROM {nodes} r JOIN t ON r.parent_id = t.region_id WHERE NOT array_contains(t.path, r.region_id))
        SELECT region_id, slug, depth, root FROM t"""
    )


@query(
    "region_ancestors",
    """WITH RECURSIVE t AS (SELECT region_id AS start, region_id, parent_id, 0 AS height FROM regions
    UNION ALL SELECT t.start, r.region_id, r.parent_id, t.height + 1 FROM regions r JOIN t ON t.parent_id = r.region_id)
    SELECT start, region_id, height::INTEGER AS height FROM t""",
    ("regions",),
)
def region_ancestors(d: Domain) -> DataFrame:
    """Every region with itself and all above it."""
    return _recursive(
        d.regions,
        """WITH RECURSIVE t AS (
            SELECT region_id AS start, region_id, parent_id, 0 AS height, array(region_id) AS path FROM {nodes}
            UNION ALL
            SELECT t.start, r.region_id, r.parent_id, t.height + 1, array_append(t.path, r.region_id)
            FROM {nodes} r JOIN t ON t.parent_id = r.region_id WHERE NOT array_contains(t.path, r.region_id))
        SELECT start, region_id, height FROM t"""
    )


@query(
    "page_by_offset",
    f"SELECT post_id, title, count(*) OVER () AS total FROM ({PUBLIC_SQL}) ORDER BY published_at DESC NULLS LAST, post_id DESC LIMIT {PAGE} OFFSET 40",
    ("members", "posts"),
)
def page_by_offset(d: Domain, page: int = 2) -> DataFrame:
    """A page with the total; the total is an aggregate of its own, so no window gathers the feed."""
    rows = public_posts(d.posts, d.members)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*_newest()).offset(page * PAGE).limit(PAGE).select("post_id", "title").join(F.broadcast(total), F.lit(True))


@query(
    "page_by_key",
    f"""SELECT post_id, title, published_at FROM ({PUBLIC_SQL}) WHERE published_at < TIMESTAMP '2024-01-15 00:00:00' OR (published_at = TIMESTAMP '2024-01-15 00:00:00' AND post_id < 500)
    ORDER BY published_at DESC, post_id DESC LIMIT {PAGE + 1}""",
    ("members", "posts"),
)
def page_by_key(d: Domain, at: str = "2024-01-15 00:00:00", post_id: int = 500) -> DataFrame:
    """What comes after a (published_at, post_id); one more than a page shows whether there is a next."""
    t = F.lit(at).cast("timestamp")
    after = (F.col("published_at") < t) | ((F.col("published_at") == t) & (F.col("post_id") < post_id))
    return public_posts(d.posts, d.members).filter(after).orderBy(F.desc("published_at"), F.desc("post_id")).limit(PAGE + 1).select("post_id", "title", "published_at")


@query(
    "page_cursors",
    "SELECT post_id, rtrim(replace(replace(base64(encode('v1:' || epoch_us(published_at) || ':' || post_id)), '+', '-'), '/', '_'), '=') AS cursor FROM posts WHERE published_at IS NOT NULL",
    ("posts",),
)
def page_cursors(d: Domain) -> DataFrame:
    """URL-safe Base64 without padding."""
    raw = F.concat_ws(":", F.lit("v1"), F.unix_micros("published_at").cast("string"), F.col("post_id").cast("string"))
    return d.posts.filter("published_at is not null").select("post_id", F.rtrim(F.translate(F.base64(F.encode(raw, "UTF-8")), "+/", "-_"), F.lit("=")).alias("cursor"))


@query(
    "summaries_in_order",
    "SELECT i.pos::INTEGER AS pos, p.post_id, p.title FROM (SELECT unnest([42, 7, 1999, 3, 7]) AS post_id, unnest(range(5)) AS pos) i JOIN posts p USING (post_id)",
    ("posts",),
)
def summaries_in_order(d: Domain, ids: tuple[int, ...] = (42, 7, 1999, 3, 7)) -> DataFrame:
    """Rows for a list of ids, in the list's order."""
    wanted = d.spark.range(1).select(F.posexplode(F.array(*map(F.lit, ids))).alias("pos", "post_id"))
    return wanted.join(d.posts, "post_id").select("pos", "post_id", "title").orderBy("pos")


@query("post_by_id", "SELECT post_id, title, brand FROM posts WHERE post_id = 17", ("posts",))
def post_by_id(d: Domain, post_id: int = 17) -> DataFrame:
    return d.posts.filter(F.col("post_id") == post_id).select("post_id", "title", "brand")


@query(
    "bookmarks_page",
    "SELECT s.user_id, p.post_id, p.title FROM saves s JOIN posts p USING (post_id) WHERE s.user_id = 11 AND p.status = 'PUBLISHED' ORDER BY p.post_id LIMIT 30",
    ("saves", "posts"),
)
def bookmarks_page(d: Domain, viewer: int = 11) -> DataFrame:
    return d.saves.filter(F.col("user_id") == viewer).join(d.posts.filter("status = 'PUBLISHED'"), "post_id").orderBy("post_id").limit(30).select("user_id", "post_id", "title")


@query(
    "region_search",
    "SELECT r.region_id, r.slug, p.slug AS parent FROM regions r LEFT JOIN regions p ON p.region_id = r.parent_id WHERE position('a' IN r.slug) > 0",
    ("regions",),
)
def region_search(d: Domain, text: str = "a") -> DataFrame:
    parents = d.regions.select(F.col("region_id").alias("parent_id"), F.col("slug").alias("parent"))
    return d.regions.join(parents, "parent_id", "left").filter(F.instr("slug", text) > 0).select("region_id", "slug", "parent")


@query(
    "name_previews",
    "SELECT doc_id, left(text, 80) AS preview, length(text) > 80 AS cut, lower(regexp_replace(trim(source), '[ \t]+', '', 'g')) AS source_key FROM documents",
)
def name_previews(d: Domain) -> DataFrame:
    return d.table("documents").select(
        "doc_id", F.left("text", F.lit(80)).alias("preview"), (F.char_length("text") > 80).alias("cut"), F.lower(F.regexp_replace(F.trim("source"), "[ \t]+", "")).alias("source_key")
    )


@query(
    "overlap_at_k",
    """WITH a AS (SELECT user_id, post_id, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, post_id) AS r FROM behaviour WHERE kind = 'view' GROUP BY 1, 2),
    b AS (SELECT user_id, post_id, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, post_id) AS r FROM behaviour WHERE kind = 'click' GROUP BY 1, 2),
    k AS (SELECT unnest([5, 10, 20]) AS k),
    j AS (SELECT k, coalesce(a.user_id, b.user_id) AS user_id, a.post_id IS NOT NULL AND b.post_id IS NOT NULL AS in_both
        FROM k JOIN (SELECT coalesce(x.user_id, y.user_id) AS u, coalesce(x.post_id, y.post_id) AS p, x.r AS rx, y.r AS ry FROM a x FULL JOIN b y ON x.user_id = y.user_id AND x.post_id = y.post_id) z ON rx <= k OR ry <= k
        LEFT JOIN a ON a.user_id = u AND a.post_id = p AND a.r <= k LEFT JOIN b ON b.user_id = u AND b.post_id = p AND b.r <= k)
    SELECT user_id, k, count(*) FILTER (WHERE in_both) AS shared, count(*) AS either, round(count(*) FILTER (WHERE in_both) / count(*), 9) AS jaccard FROM j GROUP BY 1, 2""",
    ("behaviour",),
)
def overlap_at_k(d: Domain) -> DataFrame:
    """Intersection, union and Jaccard of two rankings' first k."""

    def ranked(kind: str, name: str) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy(F.desc("n"), "post_id")
        return d.behaviour.filter(F.col("kind") == kind).groupBy("user_id", "post_id").agg(F.count("*").alias("n")).withColumn(name, F.row_number().over(w)).drop("n")

    rows = ranked("view", "ra").join(ranked("click", "rb"), ["user_id", "post_id"], "full")
    rows = rows.withColumn("k", F.explode(F.array(*map(F.lit, (5, 10, 20)))))
    a, b = F.coalesce(F.col("ra") <= F.col("k"), F.lit(False)), F.coalesce(F.col("rb") <= F.col("k"), F.lit(False))
    return rows.filter(a | b).groupBy("user_id", "k").agg(F.count_if(a & b).alias("shared"), F.count("*").alias("either")).withColumn("jaccard", F.round(F.col("shared") / F.col("either"), 9))
