"""Writers: append tables, partitioned by day, and line formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_events(df: DataFrame, path: str, least_severity: int = 2, ts: str = "ts") -> None:
    """Detections at or above a severity, appended by day; one file per day and task at most."""
    df.filter(F.col("severity") >= least_severity).withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").partitionBy("day").parquet(path)


def write_lines(df: DataFrame, line: str, path: str, rows_per_file: int = 1_000_000) -> None:
    """One text column as lines, files cut at a number of rows."""
    df.select(F.col(line).alias("value")).write.mode("append").option("maxRecordsPerFile", rows_per_file).text(path)


def stream_to(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends a stream to a table; without `every` it takes what there is and ends."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
