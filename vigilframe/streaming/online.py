"""A model that learns from a stream of feedback: mergeable state by batch, versions in a table, scoring by the last one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import run_once

SAMPLE = "id long, key double, vector array<double>"


@dataclass(frozen=True)
class Cadence:
    """When a new version is due: `least` rows learned, and `interval_us` since the last version or a rate above its limit."""

    least: int = 100
    interval_us: int = 3_600_000_000
    urgent_fp: float = 0.15
    urgent_fn: float = 0.20

    def due(self, rows: int, elapsed_us: int, fp_rate: float, fn_rate: float) -> bool:
        return rows >= self.least and (elapsed_us >= self.interval_us or fp_rate > self.urgent_fp or fn_rate > self.urgent_fn)


def priority(weight: Column, id_col: str, seed: int) -> Column:
    """The key of a weighted sample without replacement: the rows of the smallest keys. Keys do not depend on batches, so samples merge."""
    word = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 10)
    return -F.log((F.conv(word, 16, 10).cast("long") + 0.5) / (1 << 40)) / weight


def moments(rows: DataFrame, dims: int) -> dict:
    """Rows, and by feature their mean and sum of squared distances from it; counts of outcomes and the time reached."""
    each = lambda f: F.array(*[F.coalesce(f(F.col("vector")[i]), F.lit(0.0)) for i in range(dims)])
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    r = rows.agg(F.count(F.lit(1)).alias("n"), each(F.avg).alias("mean"), each(lambda c: F.var_pop(c) * F.count(c)).alias("m2"), *[count(o) for o in ("TP", "FP", "FN", "TN")], F.min("us").alias("first_us"), F.max("us").alias("last_us")).first()
    return r.asDict()


def merged(a: dict, b: dict) -> dict:
    """Moments of two sets of rows from those of each."""
    if not a["n"] or not b["n"]:
        return dict(b if not a["n"] else a)
    n = a["n"] + b["n"]
    gap = [y - x for x, y in zip(a["mean"], b["mean"], strict=True)]
    out = {"n": n, "mean": [x + d * b["n"] / n for x, d in zip(a["mean"], gap, strict=True)], "m2": [x + y + d * d * a["n"] * b["n"] / n for x, y, d in zip(a["m2"], b["m2"], gap, strict=True)]}
    out |= {o: a[o] + b[o] for o in ("TP", "FP", "FN", "TN")}
    return out | {"first_us": min(a["first_us"], b["first_us"]), "last_us": max(a["last_us"], b["last_us"])}


STATE = "n long, mean array<double>, m2 array<double>, TP long, FP long, FN long, TN long, first_us long, last_us long, version int, trained_us long"


def learner(path: str, dims: int, capacity: int = 500, cadence: Cadence = Cadence()) -> Callable[[DataFrame, int], None]:
    """A sink of feedback rows (id, us, vector, outcome, key): state/batch=N holds what was learned up to batch N, sample/batch=N the
    `capacity` rows of the smallest keys, models/version=V each version: moments and sample of all rows up to its batch.

    A batch reads the state of the batch before and overwrites its own, so a repeated batch after a restart gives the same
    state and versions. The driver holds the moments, one number a feature; the sample stays a table.
    """

    def write(df: DataFrame, to: str) -> None:
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{to}")

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.select("id", "us", "vector", "outcome", "key")
        old, kept = {"n": 0, "version": 0, "trained_us": None}, spark.createDataFrame([], SAMPLE)
        if number:
            old = spark.read.parquet(f"{path}/state/batch={number - 1}").first().asDict()
            kept = spark.read.schema(SAMPLE).parquet(f"{path}/sample/batch={number - 1}")
        now = merged(old, moments(batch, dims))
        started = old["trained_us"] if old["trained_us"] is not None else now["first_us"]
        now |= {"version": old["version"], "trained_us": started}
        write(kept.unionByName(batch.select("id", "key", "vector")).orderBy("key", "id").limit(capacity), f"sample/batch={number}")
        if now["n"]:
            rate = lambda part, whole: now[part] / whole if whole else 0.0
            if cadence.due(now["n"], now["last_us"] - started, rate("FP", now["n"]), rate("FN", now["TP"] + now["FN"])):
                now |= {"version": now["version"] + 1, "trained_us": now["last_us"]}
                write(spark.createDataFrame([tuple(now[f.split(" ")[0]] for f in STATE.split(", "))], STATE), f"models/version={now['version']}")
                write(spark.read.schema(SAMPLE).parquet(f"{path}/sample/batch={number}"), f"samples/version={now['version']}")
        write(spark.createDataFrame([tuple(now.get(f.split(" ")[0]) for f in STATE.split(", "))], STATE), f"state/batch={number}")

    return sink


def learn(stream: DataFrame, path: str, dims: int, capacity: int = 500, cadence: Cadence = Cadence()) -> None:
    """Feeds all that the stream has to the learner, batch by batch, and ends; the next call goes on from there."""
    run_once(stream, f"{path}/checkpoint", learner(path, dims, capacity, cadence))


def versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(f"{path}/models/version=*")


def last_model(spark: SparkSession, path: str) -> DataFrame:
    """The one row of the last version."""
    return versions(spark, path).orderBy(F.desc("version")).limit(1)


def score(vectors: DataFrame, model: DataFrame, vector: str = "vector") -> DataFrame:
    """vectors with score, the mean absolute z of the features by the model's moments, and the model's version."""
    rows = vectors.join(F.broadcast(model.select(F.col("n").alias("__n"), F.col("mean").alias("__mean"), F.col("m2").alias("__m2"), "version")))
    std = lambda i: F.sqrt(F.get("__m2", i) / F.greatest(F.col("__n") - 1, F.lit(1)))
    z = F.transform(vector, lambda v, i: F.when(std(i) > 0, F.abs(v - F.get("__mean", i)) / std(i)).otherwise(0.0))
    return rows.withColumn("score", F.aggregate(z, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(z), F.lit(1))).drop("__n", "__mean", "__m2")
