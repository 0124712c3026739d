"""What detections teach: recommended changes, a model that a stream keeps learning, and accuracy over a rolling span."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjust
from ..operators import evaluate as E
from ..sources import tables as T
from ..sources.scratch import folder
from ..streaming import jobs as J
from ..streaming import online as O
from .evaluate import OUT, judged
from .registry import register

#: Modules and patterns that sources and languages of judged documents stand for.
MODULES, NAMES = ("layer234", "http_detect", "signatures"), {"en": "SSH Brute Force", "de": "Port Scan", "fr": "SQL Injection", "es": "Path Traversal"}
NAME = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " ELSE 'Other' END"
TOP = "list({{'name': name, 'n': n}} ORDER BY n DESC, name) FILTER (outcome = '{0}')"
PCT = "printf('%.1f%%', {0} * 100)"


def _sql_threshold(word: str, path: str, default: float, what: str) -> str:
    up = f"least(greatest({default} * (1 + CASE WHEN fp > 0.10 THEN 0.04 ELSE 0.02 END), 0.3), 0.95)"
    down = f"least(greatest({default} * (1 - CASE WHEN fn > 0.20 THEN 0.04 ELSE 0.02 END), 0.3), 0.95)"
    has = "len(list_filter(coalesce({0}, []), lambda x: contains(lower(x.name), '" + word + "'))) > 0"
    return f"""SELECT module, '{path}' AS path, 'increase' AS direction, CASE WHEN fp > 0.10 THEN 0.04 ELSE 0.02 END AS amount, {default} AS current_value, {up} AS new_value, 'FP rate ' || {PCT.format('fp')} || ' for {what}{" detection" if word == "scan" else ""}' AS reason
 FROM s WHERE module = 'layer234' AND fp > 0.05 AND {has.format('top_fp')}
 UNION ALL SELECT module, '{path}', 'decrease', CASE WHEN fn > 0.20 THEN 0.04 ELSE 0.02 END, {default}, {down}, 'FN rate ' || {PCT.format('fn')} || ' - missing {what} attacks' FROM s WHERE module = 'layer234' AND fn > 0.10 AND {has.format('missed')}"""


@register("K19_recommendations", f"""WITH {OUT}, m AS (SELECT outcome, {NAME} AS name, ({list(MODULES)})[doc_id % 3 + 1] AS module FROM o),
 c AS (SELECT module, outcome, name, count(*) AS n FROM m GROUP BY ALL),
 r AS (SELECT module, coalesce(count(*) FILTER (outcome = 'FP') / nullif(count(*) FILTER (outcome IN ('FP', 'TN')), 0), 0) AS fp, coalesce(count(*) FILTER (outcome = 'FN') / nullif(count(*) FILTER (outcome IN ('FN', 'TP')), 0), 0) AS fn FROM m GROUP BY module),
 l AS (SELECT module, {TOP.format("FP")} AS top_fp, {TOP.format("FN")} AS missed FROM c GROUP BY module),
 s AS (SELECT * FROM r JOIN l USING (module)),
 a AS ({" UNION ALL ".join(_sql_threshold(*t) for t in adjust.THRESHOLDS)}
 UNION ALL SELECT module, 'http_detect.patterns.' || replace(lower(x.name), ' ', '_') || '.enabled', 'decrease', 0.02, 1, 0, 'Pattern ''' || x.name || ''' caused ' || x.n || ' false positives' FROM (SELECT module, unnest(list_slice(top_fp, 1, 3)) AS x FROM s WHERE module = 'http_detect' AND fp > 0.05) WHERE x.n > 10
 UNION ALL SELECT module, 'http_detect.patterns.' || replace(lower(x.name), ' ', '_'), 'increase', 0.02, 0, 1, 'Missed ' || x.n || ' ' || x.name || ' attacks' FROM (SELECT module, unnest(list_slice(missed, 1, 3)) AS x FROM s WHERE module = 'http_detect' AND fn > 0.10) WHERE x.n > 5
 UNION ALL SELECT module, 'signatures.excluded_classtypes', 'decrease', 0, 0, 0, 'Missing ' || t || ' attacks - review excluded classtypes' FROM (SELECT module, fn, list_sum(list_transform(missed, lambda x: x.n)) AS t FROM s WHERE module = 'signatures') WHERE fn > 0.15 AND t > 50
 UNION ALL SELECT module, 'signatures.excluded_classtypes', 'increase', 0, 0, 0, 'Consider excluding ''' || x.name || ''' (' || x.n || ' false positives)' FROM (SELECT module, unnest(list_slice(top_fp, 1, 2)) AS x FROM s WHERE module = 'signatures' AND fp > 0.10))
 SELECT module, path, direction, round(amount::DOUBLE, 6) AS amount, current_value::DOUBLE AS current_value, round(new_value::DOUBLE, 6) AS new_value, reason FROM a""")
def recommendations(spark, sf):
    """Changes that the accuracy of modules over the judged documents asks for."""
    name = F.lit("Other")
    for k, v in NAMES.items():
        name = F.when(F.col("lang") == k, v).otherwise(name)
    module = F.element_at(F.array(*[F.lit(m) for m in MODULES]), (F.col("doc_id") % 3 + 1).cast("int"))
    j = judged(spark, sf).withColumns({"name": name, "module": module})
    rates = E.rates(E.confusion(j, ["module"])).select("module", F.col("fpr").alias("fp_rate"), F.col("fnr").alias("fn_rate"))

    def top(outcome: str, alias: str) -> DataFrame:
        t = E.top_values(j.filter(F.col("outcome") == outcome), ["module"], "name", 10)
        return t.groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", F.col("cnt").alias("n")))), lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias(alias))

    none = F.array().cast("array<struct<name: string, n: long>>")
    stats = rates.join(top("FP", "top_fp"), "module", "left").join(top("FN", "missed"), "module", "left").withColumns({"top_fp": F.coalesce("top_fp", none), "missed": F.coalesce("missed", none)})
    out = adjust.recommend(stats)
    return out.select("module", "path", "direction", F.round("amount", 6).alias("amount"), "current_value", F.round("new_value", 6).alias("new_value"), "reason")


DAY = 86_400_000_000
CADENCE = O.Cadence(interval_us=8 * DAY, urgent_fp=0.2, urgent_fn=0.9)
OUTCOME = "CASE WHEN severity >= 2 AND port % 3 = 0 THEN 'TP' WHEN port % 3 = 0 THEN 'FP' WHEN severity >= 2 THEN 'FN' ELSE 'TN' END"


def feedback_rows(d: DataFrame) -> DataFrame:
    """Detections as feedback: vector, outcome, and a sampling key by severity."""
    outcome = E.outcome(F.col("severity") >= 2, F.col("port") % 3 == 0)
    vector = F.array("value", F.col("port").cast("double"), F.col("severity").cast("double"))
    d = d.select(F.col("event_id").alias("id"), F.unix_micros("ts").alias("us"), vector.alias("vector"), outcome.alias("outcome"), "severity")
    return d.withColumn("key", O.priority(F.col("severity") + 1, "id", 3)).drop("severity")


def learned(spark: SparkSession, sf: str) -> str:
    """Folder of a learner that has taken all detections as a stream: one file of feedback for every five days, in order."""
    at = f"{folder(spark)}/s-{uuid.uuid4().hex}"
    rows = feedback_rows(T.detections(spark, sf)).withColumn("part", F.floor(F.col("us") / (5 * DAY)))
    for (p,) in sorted(rows.select("part").distinct().collect()):  # a month has seven at most
        rows.filter(F.col("part") == p).drop("part").coalesce(1).write.parquet(f"{at}/in/part={p}")
    stream = spark.readStream.schema("id long, us long, vector array<double>, outcome string, key double").option("maxFilesPerTrigger", 1).parquet(f"{at}/in/part=*")
    O.learn(stream, f"{at}/learner", 3, 500, CADENCE)
    return f"{at}/learner"


@register("I51_online_learner", f"""WITH RECURSIVE {T.DETECTIONS}, f AS (SELECT epoch_us(ts) // {5 * DAY} AS part, epoch_us(ts) AS us, value, port, severity, {OUTCOME} AS outcome FROM det),
 b AS (SELECT row_number() OVER (ORDER BY part) AS i, * FROM (SELECT part, count(*) AS n, sum(value) AS s, sum(value * value) AS q, sum(port) AS ps, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome IN ('TP', 'FN')) AS attacks, min(us) AS lo, max(us) AS hi FROM f GROUP BY part)),
 t AS (SELECT i, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(ps) OVER w AS ps, sum(fp) OVER w AS fp, sum(fn) OVER w AS fn, sum(attacks) OVER w AS attacks, min(lo) OVER w AS lo, max(hi) OVER w AS hi FROM b WINDOW w AS (ORDER BY i ROWS UNBOUNDED PRECEDING)),
 r(i, version, trained) AS (
  SELECT 0::BIGINT, 0, (SELECT min(lo) FROM b)
  UNION ALL SELECT t.i, r.version + due::INTEGER, CASE WHEN due THEN t.hi ELSE r.trained END
  FROM r JOIN (SELECT *, n >= {CADENCE.least} AS enough, fp / n > {CADENCE.urgent_fp} OR coalesce(fn / nullif(attacks, 0), 0) > {CADENCE.urgent_fn} AS urgent FROM t) t ON t.i = r.i + 1, LATERAL (SELECT enough AND (urgent OR t.hi - r.trained >= {CADENCE.interval_us}) AS due))
 SELECT r.version, t.n::BIGINT AS rows, t.hi AS trained_us, round(t.s / t.n, 4) AS mean_value, round(sqrt((t.q - t.s * t.s / t.n) / (t.n - 1)), 4) AS std_value, round(t.ps / t.n, 4) AS mean_port
 FROM r JOIN t USING (i) JOIN r p ON p.i = r.i - 1 WHERE r.version > p.version""")
def online_learner(spark, sf):
    """The versions that a learner made of all detections, batch by batch."""
    v = O.versions(spark, learned(spark, sf))
    std = F.sqrt(F.col("m2")[0] / (F.col("n") - 1))
    return v.select("version", F.col("n").alias("rows"), "trained_us", F.round(F.col("mean")[0], 4).alias("mean_value"), F.round(std, 4).alias("std_value"), F.round(F.col("mean")[1], 4).alias("mean_port"))


@register("K09_trained_model", f"""WITH {T.DETECTIONS}, m AS (SELECT avg(value) AS mv, stddev_samp(value) AS sv, avg(port) AS mp, stddev_samp(port) AS sp, avg(severity) AS ms, stddev_samp(severity) AS ss FROM det)
 SELECT event_id, round((abs((value - mv) / sv) + abs((port - mp) / sp) + abs((severity - ms) / ss)) / 3, 6) AS score FROM det, m""")
def trained_model(spark, sf):
    """All detections scored by a model trained on all of them in one batch."""
    rows = feedback_rows(T.detections(spark, sf))
    state = O.moments(rows, 3) | {"version": 1, "trained_us": 0}
    model = spark.createDataFrame([tuple(state[f.split(" ")[0]] for f in O.STATE.split(", "))], O.STATE)
    return O.score(rows, model).select(F.col("id").alias("event_id"), F.round("score", 6).alias("score"))


@register("I58_feedback_loop", f"""WITH {T.DETECTIONS}, j AS (SELECT ts, event_type, {OUTCOME} AS outcome FROM det),
 w AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts) + to_hours(6 * i) FOR i IN [1, 2, 3, 4]]) AS "at", event_type, outcome FROM j)
 SELECT "at", event_type, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'TN') AS tn FROM w GROUP BY 1, 2""")
def feedback_loop(spark, sf):
    """Outcomes of the last 24 hours by kind of event, every six hours, from a stream."""
    at = f"{folder(spark)}/s-{uuid.uuid4().hex}"
    e = J.read_events(spark, sf).withColumn("port", F.get_json_object("props", "$.k").cast("int"))
    e = e.withColumn("outcome", E.outcome(F.col("severity") >= 2, F.col("port") % 3 == 0)).select("ts", "event_type", "outcome")
    J.run_once(J.rolling_accuracy(e, ["event_type"], "24 hours", "6 hours"), f"{at}/checkpoint", J.to_table(f"{at}/out"), mode="complete")
    out = spark.read.parquet(f"{at}/out")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(last, "batch").select(F.col("at").cast("timestamp_ntz").alias("at"), "event_type", "tp", "fp", "fn", "tn")
