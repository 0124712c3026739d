"""Anomaly scores of flow vectors against a learned baseline, their category, and scores of sequences of vectors."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anomaly import IsolationForest
from .stateful import ordered_fold

#: Features looked at first, by place in the vector; the least deviation that counts; limits of scores.
QUICK = (0, 4, 12, 13, 16, 19, 25)
LEAST_STD, Z_LIMIT, QUICK_LIMIT, IQR_FACTOR, Z_WEIGHT, IQR_WEIGHT = 1.1920929e-07, 3.0, 1.5, 1.5, 0.4, 0.3
LEAST_ROWS, TRUSTED_ROWS, ALERT, CONFIDENT = 10, 1000, 0.7, 0.6
#: In order, features of which one must be among the top five, and the category.
PLAIN_CATEGORIES = [
    (("iat_mean", "iat_std", "duration_ms"), "timing_anomaly"), (("bytes_per_second", "packets_per_second", "total_packets"), "volume_anomaly"), (("protocol_type", "dst_port_category"), "protocol_anomaly"),
]


def training_sample(vectors: DataFrame, key: list[str], most: int = 100_000) -> DataFrame:
    """At most `most` rows, those of the smallest hashes of their key: a bounded sample that does not depend on files or order.

    Rows are counted by the first three hex digits of the hash, at most 4096 counts for the driver, and only those up to
    the digits that hold the last row wanted are sorted.
    """
    mark = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]).cast("binary"))
    head, so_far = F.substring(mark, 1, 3), 0
    for r in vectors.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).orderBy("head").collect():
        so_far += r["n"]
        if so_far >= most:
            vectors = vectors.filter(head <= r["head"])
            break
    return vectors.orderBy(mark, *key).limit(most)


def learn_baseline(sample: DataFrame, features: list[str]) -> DataFrame:
    """One row: n, and by feature the mean, sample deviation and exact quartiles of a bounded sample."""
    quartiles = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))  # noqa: E731  one set of counts for both
    each = lambda f: F.array(*[F.coalesce(f(c), F.lit(0.0)) for c in features])
    return sample.agg(
        F.count(F.lit(1)).alias("base_n"), each(lambda c: F.avg(c)).alias("base_mean"), each(lambda c: F.stddev_samp(c)).alias("base_std"),
        each(lambda c: quartiles(c)[0]).alias("base_q1"), each(lambda c: quartiles(c)[1]).alias("base_q3"),
    )


def score_flows(vectors: DataFrame, baseline: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """key, x (the vector), score, confidence, top (names of the five greatest contributions) and category of each vector.

    The z part is the mean absolute z over 6, the quartile part the share of features beyond 1.5 interquartile ranges; they
    weigh 0.4 and 0.3. Contributions are z above 3 and distances from the quartiles, five of each kind at most; equal ones
    keep the order of kind and feature. With over 100 rows learned, a vector whose first-look features all lie within 1.5
    deviations is normal: score 0, confidence 1, no category. Features count from 10 rows on.
    """
    n, known = len(features), F.col("base_n") >= LEAST_ROWS
    at = lambda name, i: F.get(F.col(f"base_{name}"), i)
    rows = vectors.select(*key, F.array(*features).alias("x")).join(F.broadcast(baseline))
    z = F.transform("x", lambda v, i: F.when(known & (at("std", i) >= LEAST_STD), F.abs((v - at("mean", i)) / at("std", i))).otherwise(0.0))
    gap = lambda i: at("q3", i) - at("q1", i)
    away = lambda v, i: F.when(v < at("q1", i), (at("q1", i) - v) / F.greatest(gap(i), F.lit(0.001))).otherwise((v - at("q3", i)) / F.greatest(gap(i), F.lit(0.001)))
    out = lambda v, i: known & ((v < at("q1", i) - IQR_FACTOR * gap(i)) | (v > at("q3", i) + IQR_FACTOR * gap(i)))
    entry = lambda w, kind, i: F.struct((-F.round(w, 6)).alias("w"), F.lit(kind).alias("kind"), i.alias("i"))
    rows = rows.withColumn("z", z)
    far = F.filter(F.transform("z", lambda w, i: entry(w, 0, i)), lambda r: r["w"] < -Z_LIMIT)
    odd = F.array_compact(F.transform("x", lambda v, i: F.when(out(v, i), entry(away(v, i), 1, i))))
    rows = rows.withColumns({"far": far, "odd": odd})
    rows = rows.withColumn("top", F.slice(F.sort_array(F.concat(F.slice(F.sort_array("far"), 1, 5), F.slice(F.sort_array("odd"), 1, 5))), 1, 5))
    names = F.array(*[F.lit(c) for c in features])
    z_score = F.least(F.aggregate("z", F.lit(0.0), lambda a, w: a + w) / n / 6, F.lit(1.0))
    iqr_score = F.size("odd") / n
    quick = F.array_max(F.array(*[F.col("z")[i] for i in QUICK if i < n]))
    normal = (F.col("base_n") > 100) & (quick <= QUICK_LIMIT)
    rows = rows.select(*key, "x", normal.alias("normal"), z_score.alias("zs"), iqr_score.alias("qs"), "base_n", F.transform("top", lambda r: F.element_at(names, r["i"] + 1)).alias("top"))
    value = lambda name: F.col("x")[features.index(name)]
    among = lambda *some: F.arrays_overlap("top", F.array(*[F.lit(s) for s in some]))
    category = F.when(F.size("top") == 0, F.lit(None).cast("string"))
    category = category.when(among("syn_count", "rst_rate", "packets_per_second") & ((value("syn_count") > 100) | (value("rst_rate") > 0.5)), "dos")
    category = category.when(among("same_dst_count", "diff_srv_count") & (value("diff_srv_count") > 10), "probe")
    category = category.when(among("bytes_ratio", "src_bytes", "dst_bytes") & (value("src_bytes") > 100_000) & (value("src_bytes") > 10 * value("dst_bytes")), "data_exfiltration")
    for some, name in PLAIN_CATEGORIES:
        category = category.when(among(*some), name)
    trust = F.least(F.col("base_n") / TRUSTED_ROWS, F.lit(1.0)) * (0.5 + 0.5 * (1 - F.abs(F.col("zs") - F.col("qs"))))
    unless = lambda c, other: F.when(F.col("normal"), other).otherwise(c)
    return rows.select(
        *key, "x", unless(Z_WEIGHT * F.col("zs") + IQR_WEIGHT * F.col("qs"), 0.0).alias("score"), unless(trust, 1.0).alias("confidence"),
        unless(F.col("top"), F.array().cast("array<string>")).alias("top"), unless(category.otherwise("unknown"), F.lit(None)).alias("category"),
    )


def decide(scored: DataFrame, forest: IsolationForest | None, alert: float = ALERT, confident: float = CONFIDENT, unknown: bool = False) -> DataFrame:
    """scored with forest, the combined score in place of score, and alert.

    The combined score is 0.6 of the statistical one and 0.4 of the forest's; without a forest (fewer than 100 rows to
    learn from) the statistical one stands alone. An alert reaches `alert` with a confidence of `confident` at least, and
    its category is not `unknown` unless asked for.
    """
    if forest is None:
        out = scored.withColumn("forest", F.lit(None).cast("double"))
    else:
        held = scored.sparkSession.sparkContext.broadcast(forest)

        @F.pandas_udf("double")
        def grown(x: pd.Series) -> pd.Series:
            return pd.Series(held.value.score(np.stack(x.to_numpy()))) if len(x) else pd.Series([], dtype=float)

        out = scored.withColumn("forest", grown("x")).withColumn("score", 0.6 * F.col("score") + 0.4 * F.col("forest"))
    raised = (F.col("score") >= alert) & (F.col("confidence") >= confident)
    return out.withColumn("alert", raised if unknown else raised & ~F.col("category").eqNullSafe("unknown"))


class VectorSequence:
    """The latest vectors of an address: at most `most`, none older than window_us. Gives their score from the fifth on."""

    def __init__(self, window_us: int, most: int = 100, least: int = 5, threshold: float = 0.5):
        self.window, self.most, self.least, self.sudden = window_us, most, least, 2 * threshold
        self.kept: deque[tuple[int, list[float], float]] = deque()

    def __call__(self, row: dict) -> float | None:
        now, vector = row["us"], row["vector"]
        while self.kept and (now - self.kept[0][0] >= self.window or len(self.kept) >= self.most):
            self.kept.popleft()
        step = float(np.linalg.norm(np.subtract(vector, self.kept[-1][1]))) if self.kept else 0.0
        self.kept.append((now, vector, step))
        if len(self.kept) < self.least:
            return None
        steps = [s for _, _, s in self.kept][1:]
        return 0.5 * sum(steps) / len(steps) + 0.5 * sum(s > self.sudden for s in steps) / len(steps)


def running_moments(df: DataFrame, value: str, us: str, tie: str, slice_us: int) -> DataFrame:
    """df with run_n, run_mean and run_std (sample) of `value` over all rows up to each one in order of time, itself included.

    Time is cut into slices; a slice's own rows are summed in order, the slices before it by their totals, one row each. So
    no task gets the whole table in order.
    """
    rows = df.withColumn("__slice", F.floor(F.col(us) / slice_us))
    totals = rows.groupBy("__slice").agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    totals = totals.select("__slice", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in ("n", "s", "q")])
    own = Window.partitionBy("__slice").orderBy(us, tie).rowsBetween(Window.unboundedPreceding, 0)
    sums = {"n": F.count(value), "s": F.sum(value), "q": F.sum(F.col(value) * F.col(value))}
    rows = rows.withColumns({f"__own_{c}": f.over(own) for c, f in sums.items()}).join(totals, "__slice")
    n, s, q = (F.col(f"__own_{c}") + F.col(f"__{c}") for c in sums)
    std = F.when(n >= 2, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))).otherwise(0.0)
    return rows.select(*df.columns, n.alias("run_n"), (s / n).alias("run_mean"), std.alias("run_std"))


def temporal_scores(vectors: DataFrame, address: str, window_us: int, slice_us: int, threshold: float = 0.5, warm: int = 50, deviations: float = 2.5) -> DataFrame:
    """vectors(address, us, event_id, vector) whose address has five vectors in the window, with score, limit and anomaly.

    The limit is `threshold` until `warm` sequences have been scored, whoever's, then the mean of all scores so far plus
    2.5 of their deviations; a score counts for its own limit.
    """
    scored = ordered_fold(vectors, [address], ["us", "event_id"], lambda: VectorSequence(window_us, threshold=threshold), lambda state, row: state(row), "score", "double").filter("score IS NOT NULL")
    scored = running_moments(scored, "score", "us", "event_id", slice_us)
    limit = F.when(F.col("run_n") >= warm, F.col("run_mean") + deviations * F.col("run_std")).otherwise(threshold)
    return scored.withColumn("limit", limit).withColumn("anomaly", F.col("score") > F.col("limit")).drop("run_n", "run_mean", "run_std")
