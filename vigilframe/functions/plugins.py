"""Detection plugins: Python callables on columns, evaluated together and mapped to detections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Plugin = Callable[[DataFrame], Column]
RESULT = "struct<name:string,score:double,severity:int,action:string>"


class Registry:
    """Named plugins. Each gives a RESULT struct per row, or null where it has nothing to say."""

    def __init__(self) -> None:
        self.plugins: dict[str, Plugin] = {}

    def add(self, name: str, plugin: Plugin) -> None:
        if name in self.plugins:
            raise ValueError(f"plugin {name} exists")
        self.plugins[name] = plugin

    def evaluate(self, df: DataFrame) -> DataFrame:
        """Every result of every plugin, one row each, beside the row it is about. The rows are scanned once."""
        if not self.plugins:
            return df.withColumn("result", F.lit(None).cast(RESULT)).filter(F.lit(False))
        results = F.array(*[p(df).cast(RESULT) for p in self.plugins.values()])
        return df.withColumn("result", F.explode(F.filter(results, lambda r: r.isNotNull())))


def result(name: str, when: Column, score: Column, severity: int, action: str) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("name"), score.cast("double").alias("score"), F.lit(severity).alias("severity"), F.lit(action).alias("action")))


def to_detections(results: DataFrame, id_col: str) -> DataFrame:
    r = F.col("result")
    return results.select(id_col, r["name"].alias("detector"), r["severity"].alias("severity"), F.least(F.greatest(r["score"], F.lit(0.0)), F.lit(1.0)).alias("confidence"), r["action"].alias("action"))
