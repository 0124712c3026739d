"""The same operators on streams: watermarked windows, deduplication, keyed state, and sinks by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """Event files of a folder as a stream, with detections' columns that need no join."""
    e = spark.readStream.schema(EVENTS).option("pathGlobFilter", files).parquet(folder)
    severity = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 1).otherwise(0)
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "severity": severity, "src": F.concat(F.lit("u"), F.col("user_id").cast("string"))})


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type and window; rows later than `late` are dropped."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def distinct_alerts(events: DataFrame, keys: list[str], within: str = "60 seconds") -> DataFrame:
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def failure_bans(events: DataFrame, limit: int, window_us: int, late: str = "1 hour") -> DataFrame:
    """Bans after `limit` failures of a source within a window; firing forgets the failures.

    State is the times still inside the window, at most limit - 1 of them, and goes when event time passes their end.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["us", "event_id"])
        fired = []
        for us, event in zip(rows["us"], rows["event_id"], strict=True):
            seen = [t for t in seen if t > us - window_us] + [int(us)]
            if len(seen) >= limit:
                fired.append((key[0], int(event), int(us)))
                seen = []
        state.update((seen,))
        end = (max(seen) if seen else int(rows["us"].max())) + window_us
        state.setTimeoutTimestamp(max(end // 1000, state.getCurrentWatermarkMs() + 1))
        if fired:
            yield pd.DataFrame(fired, columns=["src", "event_id", "us"])

    keyed = events.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return keyed.groupBy("src").applyInPandasWithState(step, "src string, event_id long, us long", "seen array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Takes all there is in batches, gives each to the sink, and ends."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def to_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that a repeated batch overwrites with itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def rolling_accuracy(judged: DataFrame, keys: list[str], span: str = "24 hours", every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Outcomes of the last `span` for each key, every `every`: the buffer is the state of sliding windows, which event time empties.

    judged has ts and outcome (TP, FP, FN, TN). Rows later than `late` are dropped.
    """
    g = judged.withWatermark("ts", late).groupBy(F.window("ts", span, every), *keys)
    return g.agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FP", "FN", "TN")]).select(F.col("window.end").alias("at"), *keys, "tp", "fp", "fn", "tn")
