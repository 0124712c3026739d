"""Queries that measure accuracy: confusion, rates, calibration, latency percentiles, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..sources import tables as T
from .registry import register

D = T.DETECTIONS
J = """j AS (SELECT d.doc_id, d.lang, d.source, l.toxic = 1 AS truth, l.quality, n_chars % 7 < 3 AS said, (n_chars % 100) / 100.0 AS p, length(d.text) AS len FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
OUT = f"{J}, o AS (SELECT *, CASE WHEN truth AND said THEN 'TP' WHEN said THEN 'FP' WHEN truth THEN 'FN' ELSE 'TN' END AS outcome FROM j)"


def judged(spark, sf):
    """Labelled documents with a rule-based prediction."""
    d = T.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.length("text").alias("len"))
    j = d.join(T.table(spark, sf, "labels"), "doc_id")
    said = F.col("n_chars") % 7 < 3
    return j.select("doc_id", "lang", "source", "quality", "len", (F.col("toxic") == 1).alias("truth"), said.alias("said"), ((F.col("n_chars") % 100) / 100.0).alias("p")).withColumn("outcome", E.outcome(F.col("truth"), F.col("said")))


CM = "count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'TN') AS tn"
RATES = """CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1,
 CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 6) ELSE 0 END AS fpr, CASE WHEN fn + tp > 0 THEN round(fn / (fn + tp), 6) ELSE 0 END AS fnr"""


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@register("D28_confusion", f"WITH {OUT} SELECT lang, {CM} FROM o GROUP BY 1")
def confusion(spark, sf):
    return E.confusion(judged(spark, sf), ["lang"])


@register("D29_rates", f"WITH {OUT}, c AS (SELECT lang, {CM} FROM o GROUP BY 1) SELECT lang, {RATES} FROM c")
def rates(spark, sf):
    r = E.rates(E.confusion(judged(spark, sf), ["lang"]))
    return rounded(r, "precision", "recall", "f1", "fpr", "fnr").select("lang", "precision", "recall", "f1", "fpr", "fnr")


@register("D30_module_stats", f"WITH {OUT}, c AS (SELECT source, {CM} FROM o GROUP BY 1), t AS (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rn FROM o WHERE outcome = 'FP' GROUP BY 1, 2), a AS (SELECT source, string_agg(lang, ',' ORDER BY rn) AS top_fp FROM t WHERE rn <= 5 GROUP BY 1) SELECT source, tp, fp, fn, top_fp FROM c LEFT JOIN a USING (source)")
def module_stats(spark, sf):
    j = judged(spark, sf)
    top = E.top_values(j.filter("outcome = 'FP'"), ["source"], "lang", 5)
    top = top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "lang"))), lambda x: x["lang"]), ",").alias("top_fp"))
    return E.confusion(j, ["source"]).join(top, "source", "left").select("source", "tp", "fp", "fn", "top_fp")


@register("D31_truth_stats", f"WITH {OUT} SELECT lang, count(*) FILTER (truth) AS attacks, count(*) FILTER (outcome = 'TP') AS detected, count(*) FILTER (outcome = 'FN') AS missed, count(DISTINCT source) FILTER (truth) AS attackers FROM o GROUP BY 1")
def truth_stats(spark, sf):
    return judged(spark, sf).groupBy("lang").agg(F.count_if("truth").alias("attacks"), F.count_if(F.col("outcome") == "TP").alias("detected"), F.count_if(F.col("outcome") == "FN").alias("missed"), F.count_distinct(F.when(F.col("truth"), F.col("source"))).alias("attackers"))


@register("D32_latency", f"WITH {D}, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM det) SELECT event_type, max(value) FILTER (i = least(floor(n * 0.5), n - 1)) AS p50, max(value) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95, max(value) FILTER (i = least(floor(n * 0.99), n - 1)) AS p99 FROM r GROUP BY 1")
def latency(spark, sf):
    return E.nearest_rank(T.detections(spark, sf), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@register("D33_throughput", f"WITH {D} SELECT event_type, round(count(*) / (date_diff('second', min(ts), max(ts)) + 1), 9) AS eps, round(sum(value) * 8 / 1e6, 6) AS mbit FROM det GROUP BY 1")
def throughput(spark, sf):
    g = T.detections(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.select("event_type", F.round(F.col("n") / (F.unix_seconds("b") - F.unix_seconds("a") + 1), 9).alias("eps"), F.round(F.col("v") * 8 / 1e6, 6).alias("mbit"))


@register("D34_fp_findings", f"WITH {OUT}, c AS (SELECT source, {CM}, count(*) AS n FROM o GROUP BY 1) SELECT source, n, round(fp / (tp + fp), 6) AS fp_rate FROM c WHERE n >= 5 AND tp + fp > 0 AND fp / (tp + fp) > 0.5")
def fp_findings(spark, sf):
    c = E.confusion(judged(spark, sf), ["source"]).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    c = c.withColumn("fp_rate", E.safe(F.col("fp"), F.col("tp") + F.col("fp")))
    return c.filter("n >= 5 AND tp + fp > 0 AND fp_rate > 0.5").select("source", "n", F.round("fp_rate", 6).alias("fp_rate"))


@register("D39_calibration", f"WITH {J}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, p, CAST(truth AS INTEGER) AS y FROM j), g AS (SELECT bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM b GROUP BY 1) SELECT bin, n, round(p, 6) AS mean_p, round(y, 6) AS mean_y FROM g")
def calibration(spark, sf):
    g = E.calibration(judged(spark, sf).withColumn("y", F.col("truth").cast("int")), "p", "y")
    return g.select("bin", "n", F.round("p", 6).alias("mean_p"), F.round("y", 6).alias("mean_y"))


@register("D39_ece", f"WITH {J}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, p, CAST(truth AS INTEGER) AS y FROM j), g AS (SELECT bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM b GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM g")
def ece(spark, sf):
    g = E.calibration(judged(spark, sf).withColumn("y", F.col("truth").cast("int")), "p", "y")
    return g.agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"))


@register("D40_feedback_metrics", f"WITH {OUT}, c AS (SELECT {CM} FROM o) SELECT {RATES} FROM c")
def feedback_metrics(spark, sf):
    r = E.rates(E.confusion(judged(spark, sf), []))
    return rounded(r, "precision", "recall", "f1", "fpr", "fnr").select("precision", "recall", "f1", "fpr", "fnr")


@register("D53_stage_profile", f"WITH {D}, t AS (SELECT sum(value) AS total FROM det) SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS mx, round(sum(value) / max(total), 6) AS share, round(count(*) FILTER (severity = 3 OR port > 50) / count(*), 6) AS detection_rate FROM det, t GROUP BY 1")
def stage_profile(spark, sf):
    d = T.detections(spark, sf)
    total = d.agg(F.sum("value").alias("total"))
    g = d.groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("mx"), F.sum("value").alias("s"), F.count_if((F.col("severity") == 3) | (F.col("port") > 50)).alias("marked"))
    return g.join(F.broadcast(total)).select("stage", "n", F.round("mean", 6).alias("mean"), "mx", F.round(F.col("s") / F.col("total"), 6).alias("share"), F.round(F.col("marked") / F.col("n"), 6).alias("detection_rate"))


@register("D54_stage_scores", f"WITH {OUT}, c AS (SELECT source, {CM} FROM o GROUP BY 1) SELECT source, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall FROM c")
def stage_scores(spark, sf):
    c = E.confusion(judged(spark, sf), ["source"])
    div = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    return c.select("source", div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


@register("D55_hit_rate", f"WITH {D} SELECT src, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (port < 30) / count(*), 6) ELSE 0 END AS hit_rate FROM det GROUP BY 1")
def hit_rate(spark, sf):
    return T.detections(spark, sf).groupBy("src").agg(F.round(E.safe(F.count_if(F.col("port") < 30), F.count(F.lit(1))), 6).alias("hit_rate"))


@register("D58_feedback_summary", f"WITH {OUT} SELECT count(*) AS total, count(*) FILTER (outcome IN ('TP', 'TN')) AS correct, round(count(*) FILTER (outcome IN ('TP', 'TN')) / count(*), 6) AS accuracy FROM o")
def feedback_summary(spark, sf):
    ok = F.count_if(F.col("outcome").isin("TP", "TN"))
    return judged(spark, sf).agg(F.count(F.lit(1)).alias("total"), ok.alias("correct"), F.round(F.try_divide(ok, F.count(F.lit(1))), 6).alias("accuracy"))


@register("C19_ml_window_join", f"WITH {D} SELECT event_id, count(*) OVER (PARTITION BY port ORDER BY epoch_us(ts) RANGE BETWEEN 172800000000 PRECEDING AND 1 PRECEDING) AS same_dst, count(*) FILTER (severity >= 2) OVER (PARTITION BY src ORDER BY epoch_us(ts) RANGE BETWEEN 172800000000 PRECEDING AND 1 PRECEDING) AS same_src_severe FROM det")
def ml_window_join(spark, sf):
    from ..operators.stateful import range_window

    d = T.detections(spark, sf).withColumn("us", F.unix_micros("ts"))
    return d.select("event_id", F.count(F.lit(1)).over(range_window(["port"], 172_800_000_000, current=False)).alias("same_dst"), F.count_if(F.col("severity") >= 2).over(range_window(["src"], 172_800_000_000, current=False)).alias("same_src_severe"))
