"""Relational operators over bans, events and intelligence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str, name: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order with a tie break: one bounded heap per task, no full sort."""
    return df.orderBy(*order).limit(n)


def active(df: DataFrame, now: str, expires: str = "expires_at") -> DataFrame:
    return df.filter(F.col(expires).isNull() | (F.col(expires) > F.lit(now).cast("timestamp")))


def expired(df: DataFrame, now: str, expires: str = "expires_at") -> DataFrame:
    return df.filter(F.col(expires).isNotNull() & (F.col(expires) <= F.lit(now).cast("timestamp")))


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """Upsert semantics over a history: the last row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def upsert_counted(df: DataFrame, key: str, order: str, values: list[str], tie: str) -> DataFrame:
    """Insert-or-update over a history in one aggregation: last values by order, first creation, number of writes."""
    last = F.max_by(F.struct(*values), F.struct(order, tie))
    out = df.groupBy(key).agg(last.alias("__v"), F.min(order).alias("first_at"), F.count(F.lit(1)).alias("ban_count"))
    return out.select(key, *[F.col(f"__v.{v}").alias(v) for v in values], "first_at", "ban_count")


def flagged(df: DataFrame, cases: list[tuple[Column, str]], default: str, name: str) -> DataFrame:
    """A decision list: the first condition that holds names the verdict. Null conditions do not hold."""
    out = None
    for when, value in cases:
        out = F.when(when, value) if out is None else out.when(when, value)
    return df.withColumn(name, out.otherwise(default))
