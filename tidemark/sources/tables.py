"""Tables as files, and the domain views over them.

A view is a DataFrame here and a common table expression in VIEWS, for the same query in SQL. Members are customers, posts
are parts, places are suppliers, regions are regions and nations (ids of nations start at 100), behaviour is events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The time that stands for "now" in every query; nothing reads the clock.
NOW = "2024-02-01 00:00:00"
AUTHORS = 100
#: Lines that a task sorts to join them with their orders, about.
LINES_A_TASK = 1_000_000

VIEWS: dict[str, str] = {
    "members": "SELECT c_custkey AS user_id, c_name AS username, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal >= 0 AS active FROM customer",
    "posts": f"""SELECT p_partkey AS post_id, p_name AS title, p_brand AS brand, p_type AS theme, p_size AS size, p_retailprice AS price,
        p_partkey % {AUTHORS} AS author_id, (100 + p_partkey % 25)::BIGINT AS region_id,
        CASE WHEN p_size % 5 = 0 THEN 'DRAFT' ELSE 'PUBLISHED' END AS status,
        CASE WHEN p_size % 3 = 0 THEN 'FOLLOWERS' ELSE 'PUBLIC' END AS visibility, p_size % 7 = 0 AS hidden,
        CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE make_timestamp(epoch_us(TIMESTAMP '{NOW}') - (p_size * 86400 + p_partkey % 1000) * 1000000) END AS published_at FROM part""",
    "behaviour": """SELECT event_id, ts, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS post_id,
        CASE event_type WHEN 'signup' THEN 'follow' WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'report' ELSE event_type END AS kind FROM events""",
    "likes": "SELECT DISTINCT user_id, post_id FROM behaviour WHERE kind = 'click'",
    "saves": "SELECT DISTINCT user_id, post_id FROM behaviour WHERE kind = 'save'",
    "follows": f"SELECT DISTINCT user_id AS follower_id, post_id % {AUTHORS} AS followed_id FROM behaviour WHERE kind = 'follow'",
    "regions": """SELECT CAST(r_regionkey AS BIGINT) AS region_id, CAST(NULL AS BIGINT) AS parent_id, lower(r_name) AS slug FROM region
        UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), lower(n_name) FROM nation""",
    "runs": """SELECT o_orderkey AS run_id, o_custkey AS user_id, o_orderdate AS ran_at, l_partkey AS post_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS rank,
        l_quantity AS quantity, l_discount AS discount, l_suppkey AS place_id, l_returnflag AS flag FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
}
#: What a view needs besides itself.
_NEEDS = {"likes": ["behaviour"], "saves": ["behaviour"], "follows": ["behaviour"]}


def with_views(sql: str, *names: str) -> str:
    """The SQL behind the given views' expressions."""
    order: list[str] = []
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    head = "WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "
    sql = sql.replace("RECURSIVE", "", 1)
    rest = sql.strip()
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    return head + views + (", " + rest[4:] if rest.upper().startswith("WITH") else "\n" + rest)


class Domain:
    """The views as DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._lines: int | None = None

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @property
    def members(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("c_nationkey").alias("nation"),
            F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") >= 0).alias("active"),
        )

    @property
    def posts(self) -> DataFrame:
        published = F.timestamp_micros(F.unix_micros(now()) - (F.col("p_size") * 86400 + F.col("p_partkey") % 1000) * F.lit(1_000_000).cast("long"))
        return self.table("part").select(
            F.col("p_partkey").alias("post_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("theme"),
            F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
            (F.col("p_partkey") % AUTHORS).alias("author_id"), (100 + F.col("p_partkey") % 25).alias("region_id"),
            F.when(F.col("p_size") % 5 == 0, "DRAFT").otherwise("PUBLISHED").alias("status"),
            F.when(F.col("p_size") % 3 == 0, "FOLLOWERS").otherwise("PUBLIC").alias("visibility"),
            (F.col("p_size") % 7 == 0).alias("hidden"),
            F.when(F.col("p_partkey") % 11 != 0, published).alias("published_at"),
        )

    @property
    def behaviour(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            "event_id", stamp("ts").alias("ts"), "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("post_id"),
            F.when(kind == "signup", "follow").when(kind == "purchase", "save").when(kind == "error", "report").otherwise(kind).alias("kind"),
        )

    def _edges(self, kind: str) -> DataFrame:
        return self.behaviour.filter(F.col("kind") == kind).select("user_id", "post_id").distinct()

    @property
    def likes(self) -> DataFrame:
        return self._edges("click")

    @property
    def saves(self) -> DataFrame:
        return self._edges("save")

    @property
    def follows(self) -> DataFrame:
        return self.behaviour.filter("kind = 'follow'").select(F.col("user_id").alias("follower_id"), (F.col("post_id") % AUTHORS).alias("followed_id")).distinct()

    @property
    def regions(self) -> DataFrame:
        top = self.table("region").select(F.col("r_regionkey").cast("long").alias("region_id"), F.lit(None).cast("long").alias("parent_id"), F.lower("r_name").alias("slug"))
        low = self.table("nation").select((100 + F.col("n_nationkey")).cast("long").alias("region_id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.lower("n_name").alias("slug"))
        return top.unionByName(low)

    def dealt(self) -> tuple[DataFrame, DataFrame]:
        """Orders and lines, which meet by their order in as many tasks as the lines need, so that what one sorts doesn't grow with the tables."""
        orders, lines = self.table("orders"), self.table("lineitem")
        if self._lines is None:
            self._lines = lines.count()  # from the files' footers
        tasks = -(-self._lines // LINES_A_TASK)
        if tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            orders, lines = orders.repartition(tasks, "o_orderkey"), lines.repartition(tasks, "l_orderkey")
        return orders, lines

    @property
    def runs(self) -> DataFrame:
        """Lines with their order."""
        from pyspark.sql import Window

        orders, lines = self.dealt()
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
        items = lines.withColumn("rank", F.row_number().over(order))
        return orders.join(items, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user_id"), stamp("o_orderdate").alias("ran_at"), F.col("l_partkey").alias("post_id"),
            "rank", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_suppkey").alias("place_id"), F.col("l_returnflag").alias("flag"),
        )


def stamp(column: str) -> Column:
    """Zone-less timestamps of the files as UTC instants."""
    return F.col(column).cast("timestamp")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def public_posts(posts: DataFrame, members: DataFrame) -> DataFrame:
    """Published, public, visible, and by an active author; adds author_name."""
    authors = members.filter("active").select(F.col("user_id").alias("author_id"), F.col("username").alias("author_name"))
    return posts.filter("status = 'PUBLISHED' and visibility = 'PUBLIC' and not hidden").join(authors, "author_id")


PUBLIC_SQL = "SELECT p.*, m.username AS author_name FROM posts p JOIN members m ON m.user_id = p.author_id AND m.active WHERE p.status = 'PUBLISHED' AND p.visibility = 'PUBLIC' AND NOT p.hidden"
