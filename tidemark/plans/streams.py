"""Streaming queries over the events table, run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Domain
from ..streaming import intake
from .events import fingerprint
from .registry import ORACLES, query


class _Streamed(Domain):
    """The same views over a stream of files."""

    def table(self, name: str) -> DataFrame:
        return intake.file_stream(self.spark, self.dir, name)


@query("stream_intake")
def stream_intake(d: Domain) -> DataFrame:
    rows = _Streamed(d.spark, d.dir).behaviour.withColumn("key", F.concat_ws(":", "user_id", "post_id", "kind")).withColumn("step", F.floor(F.col("value") / 100))
    return intake.drain(d.spark, intake.intake(rows.withColumn("print", fingerprint("user_id", "post_id", "kind", "step"))), "intake")


ORACLES["stream_intake"] = ORACLES["idempotent_intake"]


@query(
    "stream_hourly_views",
    "SELECT date_trunc('hour', ts) AS hour, kind, count(*) AS n, round(sum(value), 4) AS total FROM behaviour WHERE kind = 'view' AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM behaviour WHERE kind = 'view') GROUP BY 1, 2",
    ("behaviour",),
)
def stream_hourly_views(d: Domain) -> DataFrame:
    """Hours that the watermark has closed."""
    views = _Streamed(d.spark, d.dir).behaviour.filter("kind = 'view'")
    return intake.drain(d.spark, intake.hourly(views), "hourly").select(F.col("w.start").alias("hour"), "kind", "n", "total")
