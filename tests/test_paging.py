"""Pages followed to their end, and cursors refused."""

import datetime

from pyspark.sql import functions as F

from tidemark.plans import paging


def test_pages_to_the_end_are_the_whole_ranking(spark):
    rows = spark.createDataFrame([(u, p, ("POST", "PLACE")[p % 2], 1.0 / (1 + p // 2), 0.0) for u, n in ((1, 12), (2, 5), (3, 1)) for p in range(n)], "user_id long, post_id long, type string, score double, filled double")
    items, heads = paging.stored(rows)
    items, heads = items.cache(), heads.cache()
    at, cursors, seen = datetime.datetime(2024, 1, 1), {1: None, 2: None, 3: None}, {1: [], 2: [], 3: []}
    while cursors:
        asked = spark.createDataFrame([(u, u, c, 5, at) for u, c in cursors.items()], "request long, user_id long, cursor string, size int, at timestamp")
        found = paging.pages(items, heads, asked).orderBy("user_id", "rank").collect()
        assert all(r["refusal"] is None for r in found)
        for r in found:
            seen[r["user_id"]].append(r["post_id"])
        cursors = {r["user_id"]: r["following"] for r in found if r["following"]}
    whole = {u: [r["post_id"] for r in items.filter(F.col("user_id") == u).orderBy("rank").collect()] for u in seen}
    assert seen == whole and [len(seen[u]) for u in (1, 2, 3)] == [12, 5, 1]

    # after the ranking changes, or its five minutes, or for another member, the cursor is refused
    first = paging.pages(items, heads, spark.createDataFrame([(1, 1, None, 5, at)], "request long, user_id long, cursor string, size int, at timestamp")).filter("following is not null").first()["following"]
    ask = lambda user, when: spark.createDataFrame([(1, user, first, 5, when)], "request long, user_id long, cursor string, size int, at timestamp")
    changed = paging.stored(rows.withColumn("score", F.when(F.col("post_id") == 11, 0.0).otherwise(F.col("score"))))
    assert paging.pages(*changed, ask(1, at)).first()["refusal"] == "CURSOR_SNAPSHOT_MISMATCH"
    assert paging.pages(items, heads, ask(2, at)).first()["refusal"] == "CURSOR_SNAPSHOT_MISMATCH"
    assert paging.pages(items, heads, ask(1, at + datetime.timedelta(minutes=5))).first()["refusal"] == "CURSOR_EXPIRED"
    assert paging.pages(items, heads, ask(1, at + datetime.timedelta(minutes=4, seconds=59))).count() == 5
    assert paging.pages(items, heads, ask(99, at)).first()["refusal"] == "CURSOR_SNAPSHOT_MISMATCH"


def test_what_is_no_cursor(spark):
    rows = spark.createDataFrame([(x,) for x in ("", "####", "djE", "djN8YXxifGN8eHxQT1NUfDF8MQ", None)], "c string")  # the last text has a rank that is no number
    assert all(r["d"] is None for r in rows.select(paging.decoded(F.col("c")).alias("d")).collect())
