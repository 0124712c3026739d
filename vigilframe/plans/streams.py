"""Queries that run a stream over the events to its end and read what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import tables as T
from ..sources.scratch import folder
from ..streaming import jobs as J
from .registry import register


def _folder(spark) -> str:
    return f"{folder(spark)}/s-{uuid.uuid4().hex}"


@register("I54_stream_windows", f"WITH {T.DETECTIONS} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM det GROUP BY 1, 2")
def stream_windows(spark, sf):
    at = _folder(spark)
    J.run_once(J.window_counts(J.read_events(spark, sf)), f"{at}/checkpoint", J.to_table(f"{at}/out"), mode="complete")
    # in complete mode every batch holds the whole result; the last one is read
    out = spark.read.parquet(f"{at}/out")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(last, "batch").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("I16_stream_dedup", f"WITH {T.DETECTIONS} SELECT count(DISTINCT event_id) AS n FROM det")
def stream_dedup(spark, sf):
    at = _folder(spark)
    J.run_once(J.distinct_alerts(J.read_events(spark, sf), ["event_id"]), f"{at}/checkpoint", J.to_table(f"{at}/out"))
    return spark.read.parquet(f"{at}/out").agg(F.count(F.lit(1)).alias("n"))


@register("I01_stream_bans")
def stream_bans(spark, sf):
    """The same bans as I01_find_time_ban, from keyed state."""
    at = _folder(spark)
    bans = J.failure_bans(J.read_events(spark, sf).filter("severity >= 1").select("event_id", "ts", "src"), 5, 48 * 3_600_000_000)
    J.run_once(bans, f"{at}/checkpoint", J.to_table(f"{at}/out"))
    return spark.read.parquet(f"{at}/out").select("event_id", "src")
