"""Files that a query writes first and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Unset: a temporary one if the master is local, else an error, for the hosts of a cluster share none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="vigilframe-")
        base = _LOCAL[app]
    return base.rstrip("/")


def as_text(lines: DataFrame) -> str:
    """Path of text files with the one string column of `lines`."""
    path = f"{folder(lines.sparkSession)}/lines-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def as_table(rows: DataFrame) -> DataFrame:
    """`rows` written once and read back, for queries that pass over them more than once."""
    path = f"{folder(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
