"""Accuracy measures over rows with an outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome(truth: Column, said: Column) -> Column:
    return F.when(truth & said, "TP").when(said, "FP").when(truth, "FN").otherwise("TN")


def confusion(df: DataFrame, keys: list[str], outcome_col: str = "outcome") -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(F.col(outcome_col) == o).alias(o.lower()) for o in ("TP", "FP", "FN", "TN")])


def safe(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1, false positive and false negative rate of tp, fp, fn, tn; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn), "fpr": safe(fp, fp + tn), "fnr": safe(fn, fn + tp)})


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles: the value at index floor(n * p). Ranks come from a window over the key, no list is gathered."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("__i", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    at = lambda p: F.least(F.floor(F.col("__n") * p), F.col("__n") - 1)
    return r.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == at(p), F.col(value))).alias(k) for k, p in shares.items()])


def calibration(df: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """Per bin: rows, mean score, share of positives."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("p"), F.avg(truth).alias("y"))


def top_values(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The n most frequent values of each key."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy(*keys).orderBy(F.desc("cnt"), F.asc(value))
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
