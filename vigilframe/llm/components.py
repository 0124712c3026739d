"""Connected components of a links table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, materialize_seen, relieve


def _hub(pairs: DataFrame, key: str, low: DataFrame) -> DataFrame:
    """pairs joined with low(key, m). The join key is an expression, so both sides have exchanges that adaptive execution may split."""
    low = low.select(F.concat(F.lit("n"), F.col(key).cast("string")).alias("__k"), "m")
    return pairs.withColumn("__k", F.concat(F.lit("n"), F.col(key).cast("string"))).join(low, "__k").drop("__k")


def _large_star(edges: DataFrame) -> DataFrame:
    """A row for each of the edges at most, so those that agree may stay: the small star drops them in its own shuffle."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _hub(both, "a", low).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    mine = low.select("a", F.col("m").alias("b"))
    rest = _hub(down, "a", low).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return mine.unionAll(rest).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges(a, b): root is the smallest node reachable. Self links are ignored.

    Each step writes its stars to the shared folder and counts them on the way, so plans stay short and a lost executor
    costs a reread. The number of rounds grows with the logarithm of the longest path.
    """
    relieve(edges.sparkSession)
    measures = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))}
    now, mark = materialize_seen(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), **measures)
    before = None
    for _ in range(most_rounds):
        if not mark["n"] or mark == before:
            break
        before, old = mark, now
        relieve(edges.sparkSession, 0.3)
        wide = materialize(_large_star(old))  # on its own: the small star reads it three times
        relieve(edges.sparkSession, 0.3)
        now, mark = materialize_seen(_small_star(wide), **measures)
        discard(old, wide)
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
