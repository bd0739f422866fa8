"""Event streams: idempotent intake with keyed state, late arrivals routed before the watermark, windowed counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import shared_folder

OUTCOMES = "event_id long, key string, outcome string"


#: A key's fingerprint is kept so long after its last event.
HORIZON_MS = 90 * 86_400_000
#: Keys are dealt to so many groups of keyed state: a call of Python and a row of the state store are a bucket's, not a key's.
BUCKETS = 8_192


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _classify(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a bucket is the first fingerprint of each key and the time of its last event; a key without an event in this batch goes once its horizon has passed."""
    known = {k: (first, seen) for k, first, seen in zip(*state.get)} if state.exists else {}
    told, touched = None, set()
    if not state.hasTimedOut:
        frame = pd.concat(list(frames))
        frame = frame.iloc[np.lexsort((frame["event_id"], frame["ts"]))]
        outcomes = []
        for k, print_, ms in zip(frame["key"], frame["print"], frame["_ms"].fillna(0).astype("int64").tolist()):
            if k in known:
                first, seen = known[k]
                outcomes.append("DUPLICATE" if print_ == first else "CONFLICT")
                known[k] = (first, max(seen, ms))
            else:
                outcomes.append("NEW")
                known[k] = (print_, ms)
            touched.add(k)
        told = pd.DataFrame({"event_id": frame["event_id"], "key": frame["key"], "outcome": outcomes})
    now = state.getCurrentWatermarkMs()
    known = {k: v for k, v in known.items() if k in touched or v[1] + HORIZON_MS >= now}
    if known:
        state.update((list(known), [first for first, _ in known.values()], [seen for _, seen in known.values()]))
        state.setTimeoutTimestamp(max(min(seen for _, seen in known.values()) + HORIZON_MS, now + 1))
    else:
        state.remove()
    if told is not None:
        yield told


def intake(events: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Classifies a stream of key, print, ts, event_id by each key's first event; the state is one fingerprint per key, for HORIZON_MS after its last event."""
    rows = events.select(bucket("key", BUCKETS).alias("bucket"), "key", "print", "ts", "event_id", F.unix_millis("ts").alias("_ms")).withWatermark("ts", lateness)
    return rows.groupBy("bucket").applyInPandasWithState(_classify, OUTCOMES, "keys array<string>, prints array<string>, seen array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def route_late(events: DataFrame, bound: str, tolerance: str, arrived: str = "arrived") -> DataFrame:
    """Adds verdict by arrival; nothing is dropped, so a watermark may only follow on what is on time."""
    at = F.col(arrived)
    return events.withColumn(
        "verdict", F.when(at <= F.lit(bound).cast("timestamp"), "ON_TIME").when(at <= F.lit(tolerance).cast("timestamp"), "WITHIN_TOLERANCE").otherwise("REBUILD_REQUIRED")
    )


def hourly(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Counts and sums per hour and kind; hours end when the watermark has passed them."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def drain(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, into files of the shared folder, and reads them. Restarts go on from its checkpoint."""
    folder = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def file_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parque[t]")
