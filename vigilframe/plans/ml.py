"""Queries that fit and apply statistical models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import anomaly as A
from ..sources import tables as T
from .registry import register

D = T.DETECTIONS
BASE = "b AS (SELECT avg(l_quantity) AS qm, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS pm, stddev_pop(l_extendedprice) AS ps, min(l_quantity) AS qmin, max(l_quantity) AS qmax FROM lineitem)"


def items(spark, sf):
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def with_base(spark, sf):
    li = items(spark, sf)
    return li.join(F.broadcast(A.profile(li, [], ["l_quantity", "l_extendedprice", "l_discount"])))  # one row


@register("H54_normalise", f"WITH {BASE} SELECT l_orderkey, l_linenumber, round((l_quantity - qmin) / (qmax - qmin), 6) AS mm, round((l_quantity - qm) / qs, 6) AS z FROM lineitem, b")
def normalise(spark, sf):
    q = F.col("l_quantity")
    return with_base(spark, sf).select("l_orderkey", "l_linenumber", F.round(A.minmax(q, F.col("l_quantity_min"), F.col("l_quantity_max")), 6).alias("mm"), F.round(A.zscore(q, F.col("l_quantity_mean"), F.col("l_quantity_std")), 6).alias("z"))


QUART = "r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem), q AS (SELECT max(v) FILTER (i = n // 4) AS q1, max(v) FILTER (i = n // 2) AS q2, max(v) FILTER (i = 3 * n // 4) AS q3 FROM r)"


def quartiles(li):
    """Exact nearest-rank quartiles of one column."""
    n = li.filter("l_extendedprice IS NOT NULL").count()
    values = A.at_ranks(li, "l_extendedprice", [n // 4, n // 2, 3 * n // 4])
    return li.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in zip(("q1", "q2", "q3"), values, strict=True)])


@register("D37_statistical_fit", f"WITH {QUART}, {BASE} SELECT round(pm, 4) AS mean, round(ps, 4) AS std, q1, q2, q3 FROM q, b")
def statistical_fit(spark, sf):
    li = items(spark, sf)
    b = li.agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.stddev_pop("l_extendedprice"), 4).alias("std"))
    return b.join(quartiles(li)).select("mean", "std", "q1", "q2", "q3")


@register("H55_robust_scale", f"WITH {QUART} SELECT l_orderkey, l_linenumber, round((l_extendedprice - q2) / (q3 - q1), 6) AS r, l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1) AS outlier FROM lineitem, q")
def robust_scale(spark, sf):
    li = items(spark, sf)
    j, x = li.join(F.broadcast(quartiles(li))), F.col("l_extendedprice")
    return j.select("l_orderkey", "l_linenumber", F.round(A.robust(x, F.col("q2"), F.col("q3") - F.col("q1")), 6).alias("r"), A.iqr_outlier(x, F.col("q1"), F.col("q3")).alias("outlier"))


@register("K04_iqr_score", f"WITH {QUART} SELECT count(*) FILTER (l_extendedprice < q1 - 0.5 * (q3 - q1) OR l_extendedprice > q3 + 0.5 * (q3 - q1)) AS outliers, count(*) AS n FROM lineitem, q")
def iqr_score(spark, sf):
    li = items(spark, sf)
    return li.join(F.broadcast(quartiles(li))).agg(F.count_if(A.iqr_outlier(F.col("l_extendedprice"), F.col("q1"), F.col("q3"), 0.5)).alias("outliers"), F.count(F.lit(1)).alias("n"))


@register("K03_z_score", f"WITH {BASE} SELECT l_orderkey, l_linenumber, round(least((abs((l_quantity - qm) / qs) + abs((l_extendedprice - pm) / ps)) / 2 / 3, 1.0), 6) AS score FROM lineitem, b")
def z_score(spark, sf):
    j = with_base(spark, sf)
    z = lambda c: F.abs(A.zscore(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std")))
    return j.select("l_orderkey", "l_linenumber", F.round(A.squash((z("l_quantity") + z("l_extendedprice")) / 2, 3.0), 6).alias("score"))


@register("F04_top_contributions", f"WITH {BASE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN round(abs((l_extendedprice - pm) / ps), 9) >= round(abs((l_quantity - qm) / qs), 9) THEN 'l_extendedprice' ELSE 'l_quantity' END AS feature FROM lineitem, b")
def top_contributions(spark, sf):
    """The feature that deviates most in each row; of equal ones the first by name."""
    cols = ["l_extendedprice", "l_quantity"]
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *cols)
    j = li.join(F.broadcast(A.profile(li, [], cols)))
    z = [F.struct((-F.round(F.abs(A.zscore(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std"))), 9)).alias("z"), F.lit(c).alias("n")) for c in cols]
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_min(F.array(*z))["n"].alias("feature"))


@register("K05_combined", f"WITH {BASE} SELECT l_orderkey, l_linenumber, round(0.4 * least(abs((l_quantity - qm) / qs) / 3, 1.0) + 0.3 * CASE WHEN abs((l_extendedprice - pm) / ps) > 2 THEN 1 ELSE 0 END, 6) AS score FROM lineitem, b")
def combined(spark, sf):
    j = with_base(spark, sf)
    z = lambda c: F.abs(A.zscore(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std")))
    return j.select("l_orderkey", "l_linenumber", F.round(0.4 * A.squash(z("l_quantity"), 3.0) + 0.3 * F.when(z("l_extendedprice") > 2, 1).otherwise(0), 6).alias("score"))


@register("D35_feature_baseline", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS mn, max(l_quantity) AS mx FROM lineitem GROUP BY 1")
def feature_baseline(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("std"), F.min("l_quantity").alias("mn"), F.max("l_quantity").alias("mx"))


@register("D36_baseline_sets", f"WITH {D}, h AS (SELECT *, CAST(hour(ts) AS INTEGER) AS hr FROM det) SELECT hr, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM h GROUP BY GROUPING SETS ((), (hr), (event_type))")
def baseline_sets(spark, sf):
    d = T.detections(spark, sf).withColumn("hr", F.hour("ts"))
    return d.groupingSets([[], ["hr"], ["event_type"]], "hr", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@register("D38_normaliser_fit", "WITH p AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT CAST(i AS INTEGER) AS feature, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM p GROUP BY 1")
def normaliser_fit(spark, sf):
    p = T.table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("feature", "x"))
    return p.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.stddev_samp(F.col("x").cast("double")), 6).alias("std"))


@register("H56_l2_normalise", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, round(embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS first FROM embeddings")
def l2_normalise(spark, sf):
    from ..operators.lookups import norm

    e = T.table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(norm(F.col("embedding")), 5).alias("norm"), F.round(A.l2(F.col("embedding"))[0].cast("double"), 5).alias("first"))


@register("G10_vector_concat", "SELECT a.vec_id, CAST(len(list_concat(a.embedding, b.embedding)) AS INTEGER) AS n, round(list_sum(list_concat(a.embedding, b.embedding)[60:70]), 4) AS middle FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_concat(spark, sf):
    e = T.table(spark, sf, "embeddings").select("vec_id", "embedding")
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2")), "vec_id")
    both = F.concat("embedding", "e2")
    return j.select("vec_id", F.size(both).alias("n"), F.round(F.aggregate(F.slice(both, 60, 11), F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("middle"))


@register("E08_time_aware", f"WITH {D}, w AS (SELECT event_id, value, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s FROM det WINDOW p AS (PARTITION BY src ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT event_id, CASE WHEN s > 0 THEN round((value - m) / s, 5) ELSE 0 END AS z FROM w")
def time_aware(spark, sf):
    w = Window.partitionBy("src").orderBy("ts", "event_id").rowsBetween(-20, -1)
    d = T.detections(spark, sf).select("event_id", "value", F.avg("value").over(w).alias("m"), F.stddev_pop("value").over(w).alias("s"))
    return d.select("event_id", F.when(F.col("s") > 1e-9, F.round((F.col("value") - F.col("m")) / F.col("s"), 5)).otherwise(0.0).alias("z"))


@register("E09_smoothness", f"WITH {D}, l AS (SELECT src, abs(value - lag(value) OVER (PARTITION BY src ORDER BY ts, event_id)) AS d FROM det) SELECT src, round(0.5 * avg(d) + 0.5 * avg(CASE WHEN d > 200 THEN 1.0 ELSE 0.0 END) FILTER (d IS NOT NULL), 6) AS score FROM l GROUP BY 1 HAVING count(d) > 0")
def smoothness(spark, sf):
    w = Window.partitionBy("src").orderBy("ts", "event_id")
    d = T.detections(spark, sf).select("src", F.abs(F.col("value") - F.lag("value").over(w)).alias("d")).filter("d IS NOT NULL")
    return d.groupBy("src").agg(F.round(0.5 * F.avg("d") + 0.5 * F.avg((F.col("d") > 200).cast("double")), 6).alias("score"))


@register("E10_weighted_recent", f"WITH {D}, r AS (SELECT src, value, row_number() OVER (PARTITION BY src ORDER BY ts, event_id) AS rn FROM det) SELECT src, round(sum(value * rn) / sum(rn), 6) AS prediction FROM r GROUP BY 1")
def weighted_recent(spark, sf):
    w = Window.partitionBy("src").orderBy("ts", "event_id")
    r = T.detections(spark, sf).select("src", "value", F.row_number().over(w).alias("rn"))
    return r.groupBy("src").agg(F.round(F.sum(F.col("value") * F.col("rn")) / F.sum("rn"), 6).alias("prediction"))


@register("E12_sliding_samples", f"WITH {D} SELECT event_id, round(avg(value) OVER w, 5) AS mean, CASE WHEN count(*) OVER w < 2 THEN 1.0 ELSE round(greatest(var_pop(value) OVER w, 1e-6), 4) END AS var FROM det WINDOW w AS (PARTITION BY src ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def sliding_samples(spark, sf):
    w = Window.partitionBy("src").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return T.detections(spark, sf).select("event_id", F.round(F.avg("value").over(w), 5).alias("mean"), F.when(F.count(F.lit(1)).over(w) < 2, 1.0).otherwise(F.round(F.greatest(F.var_pop("value").over(w), F.lit(1e-6)), 4)).alias("var"))


VOTES = "s AS (SELECT event_id, value / 500 AS a, severity / 3.0 AS b, port / 100.0 AS c FROM det)"


@register("K16_votes", f"WITH {D}, {VOTES} SELECT event_id, round((a + b + c) / 3, 6) AS average, round((0.5 * a + 0.3 * b + 0.2 * c), 6) AS weighted, round(greatest(a, b, c), 6) AS mx, round(a + b + c - greatest(a, b, c) - least(a, b, c), 6) AS median, CASE WHEN (a > 0.5)::INT + (b > 0.5)::INT + (c > 0.5)::INT >= 2 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS hard FROM s")
def votes(spark, sf):
    s = [F.col("value") / 500, F.col("severity") / 3.0, F.col("port") / 100.0]
    w = [0.5, 0.3, 0.2]
    return T.detections(spark, sf).select("event_id", *[(A.vote(s, w, h) if h == "hard" else F.round(A.vote(s, w, h), 6)).alias(n) for h, n in (("average", "average"), ("weighted", "weighted"), ("max", "mx"), ("median", "median"), ("hard", "hard"))])


@register("K17_ensemble", f"WITH {D}, {VOTES} SELECT event_id, (0.5 * a + 0.3 * b + 0.2 * c) > 0.5 AS anomaly FROM s")
def ensemble(spark, sf):
    s = [F.col("value") / 500, F.col("severity") / 3.0, F.col("port") / 100.0]
    return T.detections(spark, sf).select("event_id", (A.vote(s, [0.5, 0.3, 0.2], "weighted") > 0.5).alias("anomaly"))


@register("K06_category", f"WITH {D} SELECT event_id, CASE WHEN port IN (22, 23) THEN 'brute_force' WHEN value > 200 THEN 'exfiltration' WHEN severity = 3 THEN 'error' ELSE 'unknown' END AS category FROM det")
def category(spark, sf):
    return T.detections(spark, sf).select("event_id", F.when(F.col("port").isin(22, 23), "brute_force").when(F.col("value") > 200, "exfiltration").when(F.col("severity") == 3, "error").otherwise("unknown").alias("category"))


@register("K02_quick_check", f"WITH {D}, b AS (SELECT src, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM det GROUP BY 1) SELECT event_id, n >= 10 AND abs((value - m) / s) > 3 AS suspicious FROM det JOIN b USING (src) WHERE s > 0")
def quick_check(spark, sf):
    d = T.detections(spark, sf)
    b = A.profile(d, ["src"], ["value"])
    return d.join(b, "src").filter("value_std > 0").select("event_id", ((F.col("n") >= 10) & (F.abs(A.zscore(F.col("value"), F.col("value_mean"), F.col("value_std"))) > 3)).alias("suspicious"))


@register("K01_flow_features", f"WITH {D} SELECT event_id, round(ln(1 + value), 6) AS log_bytes, CAST(hour(ts) AS INTEGER) AS hr, count(*) OVER (PARTITION BY src ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS recent FROM det")
def flow_features(spark, sf):
    from ..operators.stateful import range_window

    d = T.detections(spark, sf).withColumn("us", F.unix_micros("ts"))
    return d.select("event_id", F.round(F.log1p("value"), 6).alias("log_bytes"), F.hour("ts").alias("hr"), F.count(F.lit(1)).over(range_window(["src"], 86_400_000_000, current=False)).alias("recent"))


@register("K18_platt")
def platt_calibration(spark, sf):
    """Scores calibrated by a logistic map that is fitted on 100 bins of the labelled documents."""
    from .evaluate import judged

    j = judged(spark, sf)
    bins = j.groupBy(F.floor(F.col("p") * 100).alias("b")).agg(F.avg("p").alias("x"), F.avg(F.col("truth").cast("int")).alias("y")).orderBy("b").collect()  # 100 rows at most
    a, b = A.platt(np.array([r["x"] for r in bins]), np.array([r["y"] for r in bins])) if bins else (1.0, 0.0)
    return j.select("doc_id", (1 / (1 + F.exp(-(F.col("p") * a + b)))).alias("calibrated"))


@register("K10_isolation_forest")
def isolation_forest(spark, sf):
    """Every line item scored by a forest grown from a sample of 4096 rows by hash."""
    li = items(spark, sf)
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    sample = li.orderBy(F.xxhash64("l_orderkey", "l_linenumber", *cols), "l_orderkey", "l_linenumber", *cols).limit(4096).select(*cols).collect()
    held = spark.sparkContext.broadcast(A.IsolationForest(np.array([list(r) for r in sample], dtype=float).reshape(-1, 4)) if sample else None)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(held.value.score(np.column_stack([p.to_numpy(float) for p in part])))

    return li.select("l_orderkey", "l_linenumber", score(*cols).alias("score"))


@register("I49_reservoir", f"WITH {D} SELECT event_id, src FROM det ORDER BY md5(event_id || ':7'), event_id LIMIT 500")
def reservoir(spark, sf):
    """A fixed-size uniform sample: the rows of the smallest hashes, one bounded heap per task."""
    return T.detections(spark, sf).orderBy(F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":7")).cast("binary")), "event_id").limit(500).select("event_id", "src")


@register("I50_prioritised", f"WITH {D} SELECT event_id, severity FROM det ORDER BY -ln((CAST('0x' || substr(md5(event_id || ':3'), 1, 10) AS BIGINT) + 0.5::DOUBLE) / 1099511627776) / (severity + 1), event_id LIMIT 500")
def prioritised(spark, sf):
    """A weighted sample without replacement: the smallest exponential draws by weight."""
    word = F.substring(F.md5(F.concat(F.col("event_id").cast("string"), F.lit(":3")).cast("binary")), 1, 10)
    u = (F.conv(word, 16, 10).cast("long") + 0.5) / (1 << 40)
    return T.detections(spark, sf).orderBy(-F.log(u) / (F.col("severity") + 1), "event_id").limit(500).select("event_id", "severity")


@register("E08_hourly_score", f"WITH {D}, h AS (SELECT hour(ts) AS hr, count(value) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s, avg(port) AS pm, coalesce(stddev_samp(port), 0) AS ps FROM det GROUP BY 1) SELECT event_id, round(CASE WHEN n > 10 THEN ((CASE WHEN s > 0 THEN abs((value - m) / s) ELSE 0 END) + (CASE WHEN ps > 0 THEN abs((port - pm) / ps) ELSE 0 END)) / 2 ELSE 0 END, 6) AS score FROM det JOIN h ON hr = hour(ts)")
def hourly_score(spark, sf):
    d = T.detections(spark, sf).select("event_id", "ts", "value", "port")
    return A.hourly_score(d, "ts", ["value", "port"]).select("event_id", F.round("score", 6).alias("score"))


@register("E09_vector_smoothness", f"WITH {D}, l AS (SELECT src, value / 100 AS x, port / 50 AS y, lag(value / 100) OVER w AS px, lag(port / 50) OVER w AS py FROM det WINDOW w AS (PARTITION BY src ORDER BY ts, event_id)), d AS (SELECT src, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d FROM l) SELECT src, round(coalesce(0.5::DOUBLE * avg(d) + 0.5::DOUBLE * avg(CASE WHEN d > 1 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0 END), 0), 6) AS score FROM d GROUP BY 1")
def vector_smoothness(spark, sf):
    d = T.detections(spark, sf).select("src", "ts", "event_id", F.array(F.col("value") / 100, F.col("port") / 50).alias("v"))
    return A.smoothness(d, ["src"], ["ts", "event_id"], "v").select("src", F.round("score", 6).alias("score"))


@register("K13_boosted_stumps")
def boosted_stumps(spark, sf):
    """Every line item's score for being returned, by stumps fitted on 8192 rows of the smallest hashes."""
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *[F.col(c).cast("double") for c in cols])
    some = li.dropna().orderBy(F.xxhash64("l_orderkey", "l_linenumber", *cols), "l_orderkey", "l_linenumber", *cols).limit(8192).select(*cols, (F.col("l_returnflag") == "R").cast("double").alias("y")).collect()
    data = np.array([list(r) for r in some], dtype=float).reshape(-1, 5)
    model = A.BoostedStumps(data[:, :4], data[:, 4])
    return li.select("l_orderkey", "l_linenumber", F.round(model.score([F.col(c) for c in cols]), 6).alias("score"))
