"""Queries that correlate detections: thresholds, deduplication, aggregation, sequences, incidents, kill chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stateful as S
from ..sources import tables as T
from .registry import register

D = T.DETECTIONS
#: Event type, its tactic, and the tactic's place in the kill chain.
TACTICS = [("view", "Reconnaissance", 1), ("click", "InitialAccess", 3), ("signup", "Persistence", 5), ("purchase", "Collection", 11), ("error", "Impact", 14)]
#: Kill-chain patterns (name, required tactics, least number of them).
CHAINS = [("intrusion", ["Reconnaissance", "InitialAccess"], 2), ("breach", ["Collection", "Impact"], 1), ("foothold", ["Persistence", "InitialAccess", "Collection"], 2)]
H = 3_600_000_000




def folded(source: str, state: str, seed: str, step: str, out: str) -> str:
    """SQL of an ordered fold: rows of `source` (event_id, k, us and more) are met in order, one at a time, by the state of their key.

    seed gives the state before the first row; step is a query over `x`, a row beside its key's state, that gives k, rn, the
    new state, event_id and the result.
    """
    return f"""WITH RECURSIVE {D}, g AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, event_id) AS rn FROM ({source})),
 st(k, rn, {state}, event_id, out) AS (SELECT k, 0::BIGINT, {seed} FROM g GROUP BY 1 UNION ALL {step.replace("FROM x", f"FROM (SELECT g.*, {', '.join(f'st.{c.strip()}' for c in state.split(','))} FROM st JOIN g ON g.k = st.k AND g.rn = st.rn + 1) x")}) {out}"""


def anchored(source: str, width: int, reopen: str = ">") -> str:
    """SQL: rows of `source` with the time their window opened, as `a`."""
    return f"""WITH RECURSIVE {D}, g AS ({source}), o(k, at_us) AS (SELECT k, min(us) FROM g GROUP BY 1 UNION ALL SELECT o.k, min(g.us) FROM o JOIN g ON g.k = o.k AND g.us {reopen} o.at_us + {width} GROUP BY o.k, o.at_us),
 a AS (SELECT g.*, o.at_us AS opened FROM g ASOF JOIN o ON g.k = o.k AND g.us >= o.at_us)"""


BY_SRC = "SELECT event_id, src AS k, epoch_us(ts) AS us, port, value FROM det WHERE "


def det(spark, sf):
    return T.detections(spark, sf).withColumn("us", F.unix_micros("ts"))


@register("I01_find_time_ban", folded(BY_SRC + "severity >= 1", "seen", "[]::BIGINT[], NULL::BIGINT, false",
 f"SELECT k, rn, CASE WHEN len(s) >= 5 THEN [] ELSE s END, event_id, len(s) >= 5 FROM (SELECT *, list_append(list_filter(seen, lambda t: t > us - {48 * H}), us) AS s FROM x)", "SELECT event_id, k AS src FROM st WHERE out"))
def find_time_ban(spark, sf):
    d = det(spark, sf).filter("severity >= 1").select("event_id", "src", "us")
    return S.fold(d, ["src"], lambda: S.FindTime(5, 48 * H)).filter("fired").select("event_id", "src")


@register("I02_port_scan_ban", folded(BY_SRC + "true", "seen", "[]::STRUCT(p INTEGER, t BIGINT)[], NULL::BIGINT, false",
 f"SELECT k, rn, CASE WHEN len(s) >= 8 THEN [] ELSE s END, event_id, len(s) >= 8 FROM (SELECT *, CASE WHEN list_contains(list_transform(l, lambda q: q.p), port) THEN l ELSE list_append(l, {{'p': port, 't': us}}) END AS s FROM (SELECT *, list_filter(seen, lambda q: q.t > us - {72 * H}) AS l FROM x))", "SELECT event_id, k AS src FROM st WHERE out"))
def port_scan_ban(spark, sf):
    d = det(spark, sf).select("event_id", "src", "us", "port")
    return S.fold(d, ["src"], lambda: S.DistinctPorts(8, 72 * H)).filter("fired").select("event_id", "src")


@register("I03_severity_threshold", f"{anchored(BY_SRC + 'severity >= 2', 48 * H)} SELECT event_id, row_number() OVER (PARTITION BY k, opened ORDER BY us, event_id) >= 3 AS fired FROM a")
def severity_threshold(spark, sf):
    d = det(spark, sf).filter("severity >= 2").select("event_id", "src", "us")
    return S.fold(d, ["src"], lambda: S.FixedWindow(3, 48 * H)).select("event_id", "fired")


@register("I04_rule_threshold", f"{anchored('''SELECT event_id, src || ':' || event_type AS k, epoch_us(ts) AS us FROM det''', 96 * H)}, p AS (SELECT event_id, row_number() OVER (PARTITION BY k, opened ORDER BY us, event_id) AS n FROM a) SELECT event_id, 'limit' AS kind FROM p WHERE n <= 2 UNION ALL SELECT event_id, 'threshold' FROM p WHERE n % 2 = 0 UNION ALL SELECT event_id, 'both' FROM p WHERE n = 2")
def rule_threshold(spark, sf):
    """All three kinds of threshold from one pass over each key."""
    d = det(spark, sf).select("event_id", "src", "event_type", "us")
    rows = S.anchored_windows(d, ["src", "event_type"], ["us", "event_id"], 96 * H)
    fires = [(k, S.RuleThreshold(k, 2, 96 * H).of(F.col("__window"), F.col("__place"), F.col("__opened"))) for k in ("limit", "threshold", "both")]
    return rows.select("event_id", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in fires]))).alias("kind"))


@register("I05_flowbits", folded("SELECT event_id, src AS k, epoch_us(ts) AS us, event_id % 4 AS op, port % 3 AS b FROM det", "bits", "[false, false, false], NULL::BIGINT, false",
 "SELECT k, rn, s, event_id, s[b + 1] FROM (SELECT *, list_transform(bits, lambda v, i: CASE WHEN i <> b + 1 THEN v WHEN op = 0 THEN true WHEN op = 2 THEN NOT v WHEN op = 3 THEN false ELSE v END) AS s FROM x)", "SELECT event_id, out AS isset FROM st WHERE rn > 0"))
def flowbits(spark, sf):
    op = F.element_at(F.array(*[F.lit(x) for x in ("set", "isset", "toggle", "unset")]), (F.col("event_id") % 4 + 1).cast("int"))
    d = det(spark, sf).select("event_id", "src", "us", op.alias("op"), F.concat(F.lit("b"), (F.col("port") % 3).cast("string")).alias("bit"))
    return S.fold(d, ["src"], S.Flowbits, "isset").select("event_id", "isset")


@register("I16_duplicates", f"{anchored('''SELECT event_id, src || ':' || event_type AS k, epoch_us(ts) AS us FROM det''', 24 * H, '>=')} SELECT min(event_id) AS event_id FROM a WHERE us = opened GROUP BY k, opened")
def duplicates(spark, sf):
    d = det(spark, sf).select("event_id", "src", "event_type", "us")
    return S.fold(d, ["src", "event_type"], lambda: S.FirstSeen(24 * H), "first").filter("first").select("event_id")


@register("E01_anchored_windows", f"{anchored(BY_SRC + 'true', 24 * H)}, w AS (SELECT k AS src, opened AS start_us, count(*) AS n FROM a GROUP BY 1, 2) SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY start_us) - 1 AS BIGINT) AS win, start_us, n FROM w")
def anchored_windows(spark, sf):
    d = S.fold(det(spark, sf).select("event_id", "src", "us"), ["src"], lambda: S.AnchoredWindow(24 * H), "win", "bigint")
    return d.groupBy("src", "win").agg(F.min("us").alias("start_us"), F.count(F.lit(1)).alias("n"))


@register("E11_ema", folded(BY_SRC + "true", "mean, var", "NULL::DOUBLE, 1.0::DOUBLE, NULL::BIGINT, false",
 "SELECT k, rn, m, CASE WHEN mean IS NULL THEN var ELSE greatest(0.000001::DOUBLE, 0.9::DOUBLE * var + 0.1::DOUBLE * (value - mean) * (value - m)) END, event_id, true FROM (SELECT *, CASE WHEN mean IS NULL THEN value ELSE mean + 0.1::DOUBLE * (value - mean) END AS m FROM x)", "SELECT event_id, round(mean, 6) AS mean, round(var, 6) AS var FROM st WHERE out"))
def ema(spark, sf):
    d = S.fold(det(spark, sf).select("event_id", "src", "us", "value"), ["src"], lambda: S.Ema(0.1), "e", "struct<mean:double,var:double>")
    return d.select("event_id", F.round("e.mean", 6).alias("mean"), F.round("e.var", 6).alias("var"))


@register("I53_action_limit", folded(BY_SRC + "severity = 3", "seen", "[]::BIGINT[], NULL::BIGINT, false",
 f"SELECT k, rn, CASE WHEN len(s) < 2 THEN list_append(s, us) ELSE s END, event_id, len(s) < 2 FROM (SELECT *, list_filter(seen, lambda t: t > us - {72 * H}) AS s FROM x)", "SELECT event_id, out AS allowed FROM st WHERE rn > 0"))
def action_limit(spark, sf):
    return S.fold(det(spark, sf).filter("severity = 3").select("event_id", "src", "us"), ["src"], lambda: S.SlidingLimit(2, 72 * H), "allowed").select("event_id", "allowed")


BUCKETS = f"""WITH {D}, g AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src, event_type ORDER BY ts, event_id) AS gap FROM det),
 b AS (SELECT *, CAST(sum(CASE WHEN gap > {72 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY src, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bucket FROM g)"""


def buckets(spark, sf):
    return S.gap_buckets(det(spark, sf), ["src", "event_type"], 72 * H)


@register("D19_alert_buckets", f"{BUCKETS} SELECT event_id, bucket, row_number() OVER (PARTITION BY src, event_type, bucket ORDER BY ts, event_id) >= 5 AS suppressed FROM b")
def alert_buckets(spark, sf):
    return buckets(spark, sf).select("event_id", "bucket", (F.col("place") >= 5).alias("suppressed"))


@register("D20_alert_rate", f"{BUCKETS} SELECT src, event_type, bucket, count(*) AS n, round(count(*) / greatest(1, floor((max(us) - min(us)) / 1e6)), 9) AS rate FROM b GROUP BY 1, 2, 3")
def alert_rate(spark, sf):
    g = buckets(spark, sf).groupBy("src", "event_type", "bucket").agg(F.count(F.lit(1)).alias("n"), F.floor((F.max("us") - F.min("us")) / 1e6).alias("s"))
    return g.select("src", "event_type", "bucket", "n", F.round(F.col("n") / F.greatest(F.lit(1), "s"), 9).alias("rate"))


@register("D21_alert_report", f"{BUCKETS} SELECT src, event_type, bucket, count(*) AS n FROM b GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def alert_report(spark, sf):
    return buckets(spark, sf).groupBy("src", "event_type", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


INC = f"""WITH {D}, g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src ORDER BY ts, event_id) AS gap FROM det), i AS (SELECT *, CAST(sum(CASE WHEN gap > {24 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS incident FROM g)"""


def incidents(spark, sf):
    """Events of one source no more than a day apart form an incident."""
    return S.gap_buckets(det(spark, sf), ["src"], 24 * H).withColumnRenamed("bucket", "incident")


@register("D22_incident_rollup", f"{INC} SELECT src, incident, count(*) AS events, max(severity) AS severity, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, epoch_us(max(ts)) AS last_us, min(event_id) AS first_event FROM i GROUP BY 1, 2")
def incident_rollup(spark, sf):
    return incidents(spark, sf).groupBy("src", "incident").agg(F.count(F.lit(1)).alias("events"), F.max("severity").alias("severity"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"), F.max("us").alias("last_us"), F.min("event_id").alias("first_event"))


@register("D23_incident_sets", f"{INC} SELECT incident, count(DISTINCT src) AS sources, count(DISTINCT port) AS destinations FROM i GROUP BY 1")
def incident_sets(spark, sf):
    return incidents(spark, sf).groupBy("incident").agg(F.count_distinct("src").alias("sources"), F.count_distinct("port").alias("destinations"))


TAC = "CASE event_type WHEN 'view' THEN 'Reconnaissance' WHEN 'click' THEN 'InitialAccess' WHEN 'signup' THEN 'Persistence' WHEN 'purchase' THEN 'Collection' ELSE 'Impact' END"


def staged(spark, sf):
    dim = F.broadcast(spark.createDataFrame(TACTICS, "event_type string, tactic string, tactic_order int"))  # one row per event type
    return incidents(spark, sf).join(dim, "event_type")


@register("D25_kill_chain", f"{INC} SELECT src, incident, {TAC} AS tactic, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM i GROUP BY 1, 2, 3")
def kill_chain(spark, sf):
    return staged(spark, sf).groupBy("src", "incident", "tactic").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@register("D26_chain_patterns", f"""{INC}, s AS (SELECT src, incident, list(DISTINCT {TAC}) AS tactics, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'signup' THEN 5 WHEN 'purchase' THEN 11 ELSE 14 END) AS top FROM i GROUP BY 1, 2),
 p(ord, name, req, least_n) AS (VALUES (0, 'intrusion', ['Reconnaissance', 'InitialAccess'], 2), (1, 'breach', ['Collection', 'Impact'], 1), (2, 'foothold', ['Persistence', 'InitialAccess', 'Collection'], 2)),
 m AS (SELECT *, len(list_intersect(tactics, req)) AS hits FROM s, p), c AS (SELECT *, least(1.0, 0.7 * hits / len(req) + 0.3) AS conf FROM m WHERE hits >= least_n),
 b AS (SELECT *, row_number() OVER (PARTITION BY src, incident ORDER BY conf DESC, ord) AS rn FROM c) SELECT src, incident, name AS pattern, round(conf, 6) AS confidence, round(top / 14, 6) AS progression FROM b WHERE rn = 1""")
def chain_patterns(spark, sf):
    s = staged(spark, sf).groupBy("src", "incident").agg(F.collect_set("tactic").alias("t"), F.max("tactic_order").alias("top"))
    options = []
    for i, (name, req, least) in enumerate(CHAINS):
        hits = F.size(F.array_intersect("t", F.array(*[F.lit(x) for x in req])))
        options.append(F.when(hits >= least, F.struct(F.least(F.lit(1.0), 0.7 * hits / len(req) + 0.3).alias("c"), F.lit(-i).alias("o"), F.lit(name).alias("n"))))
    s = s.withColumn("b", F.array_max(F.array(*options))).filter("b IS NOT NULL")
    return s.select("src", "incident", F.col("b.n").alias("pattern"), F.round("b.c", 6).alias("confidence"), F.round(F.col("top") / 14, 6).alias("progression"))


@register("E07_sequence", f"""WITH {D}, a AS (SELECT event_id, src, epoch_us(ts) AS us FROM det WHERE event_type = 'view'), n AS (SELECT a.event_id, min(epoch_us(b.ts)) AS nxt, min(a.us) AS us FROM a JOIN det b ON a.src = b.src AND b.event_type = 'error' AND epoch_us(b.ts) > a.us GROUP BY 1) SELECT event_id, nxt FROM n WHERE nxt - us < {24 * H}""")
def sequence(spark, sf):
    nxt = S.next_after(["src"], F.col("event_type") == "error", F.col("us"))
    d = det(spark, sf).withColumn("nxt", nxt)
    return d.filter((F.col("event_type") == "view") & (F.col("nxt") - F.col("us") < 24 * H)).select("event_id", "nxt")


@register("I17_count_rules", f"WITH {D}, c AS (SELECT event_id, event_type, count(*) FILTER (event_type = 'error') OVER w AS errors, count(*) OVER w AS alls FROM det WINDOW w AS (PARTITION BY src ORDER BY epoch_us(ts) RANGE BETWEEN {96 * H} PRECEDING AND CURRENT ROW)) SELECT event_id, CASE WHEN errors >= 3 THEN 'error_burst' WHEN alls >= 12 THEN 'campaign' END AS rule FROM c WHERE errors >= 3 OR alls >= 12")
def count_rules(spark, sf):
    w = S.range_window(["src"], 96 * H)
    c = det(spark, sf).select("event_id", F.count_if(F.col("event_type") == "error").over(w).alias("errors"), F.count(F.lit(1)).over(w).alias("alls"))
    return c.withColumn("rule", F.when(F.col("errors") >= 3, "error_burst").when(F.col("alls") >= 12, "campaign")).filter("rule IS NOT NULL").select("event_id", "rule")


@register("I20_violations", f"WITH {D}, r AS (SELECT event_id, count(*) OVER w AS n, sum(severity * 5) OVER w AS score FROM det WINDOW w AS (PARTITION BY src ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, n, CAST(score AS BIGINT) AS score, CASE WHEN score >= 100 THEN 1440 WHEN score >= 50 THEN 120 WHEN n >= 5 THEN 30 ELSE 0 END AS block_minutes FROM r")
def violations(spark, sf):
    w = Window.partitionBy("src").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    r = det(spark, sf).select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.sum(F.col("severity") * 5).over(w).alias("score"))
    return r.withColumn("block_minutes", F.when(F.col("score") >= 100, 1440).when(F.col("score") >= 50, 120).when(F.col("n") >= 5, 30).otherwise(0))


@register("I25_sliding_failures", f"WITH {D}, c AS (SELECT event_id, count(*) FILTER (severity >= 1) OVER (PARTITION BY src ORDER BY epoch_us(ts) RANGE BETWEEN {48 * H} PRECEDING AND CURRENT ROW) AS failures FROM det) SELECT event_id, failures FROM c WHERE failures >= 4")
def sliding_failures(spark, sf):
    return det(spark, sf).select("event_id", F.count_if(F.col("severity") >= 1).over(S.range_window(["src"], 48 * H)).alias("failures")).filter("failures >= 4")


@register("I26_mass_mailer", f"WITH {D} SELECT event_id, len(list_distinct(list(port) OVER (PARTITION BY src ORDER BY epoch_us(ts) RANGE BETWEEN {96 * H} PRECEDING AND CURRENT ROW))) AS rcpts FROM det")
def mass_mailer(spark, sf):
    return S.distinct_in_window(det(spark, sf).select("event_id", "src", "us", "port"), ["src"], "port", 96 * H, "rcpts").select("event_id", "rcpts")


@register("I28_arp_changes", f"WITH {D}, l AS (SELECT event_id, src, ts, port % 4 <> lag(port % 4) OVER (PARTITION BY src ORDER BY ts, event_id) AS ch FROM det) SELECT event_id, CAST(sum(CASE WHEN ch THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS changes FROM l")
def arp_changes(spark, sf):
    w = Window.partitionBy("src").orderBy("us", "event_id")
    mac = F.col("port") % 4
    d = det(spark, sf).withColumn("ch", F.coalesce((mac != F.lag(mac).over(w)).cast("int"), F.lit(0)))
    return d.select("event_id", F.sum("ch").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("changes"))


@register("I29_dhcp_starvation", f"WITH {D} SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, count(DISTINCT src) AS clients FROM det GROUP BY 1 HAVING count(DISTINCT src) >= 5")
def dhcp_starvation(spark, sf):
    g = det(spark, sf).groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count_distinct("src").alias("clients")).filter("clients >= 5")
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "clients")


@register("I30_ra_flood", f"WITH {D} SELECT src, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, bool_or(port >= 90) AS unknown FROM det GROUP BY 1, 2 HAVING count(*) >= 3")
def ra_flood(spark, sf):
    g = det(spark, sf).groupBy("src", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("port") >= 90).alias("unknown")).filter("n >= 3")
    return g.select("src", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "unknown")


@register("I36_origin_change", f"WITH {D}, l AS (SELECT event_id, port, user_id, lag(user_id) OVER (PARTITION BY port ORDER BY ts, event_id) AS was FROM det) SELECT event_id, was FROM l WHERE was IS NOT NULL AND was <> user_id AND NOT (user_id < 20 AND was >= 20)")
def origin_change(spark, sf):
    w = Window.partitionBy("port").orderBy("us", "event_id")
    d = det(spark, sf).withColumn("was", F.lag("user_id").over(w))
    return d.filter((F.col("was") != F.col("user_id")) & ~((F.col("user_id") < 20) & (F.col("was") >= 20))).select("event_id", "was")


@register("I37_root_changes", f"WITH {D}, r AS (SELECT event_id, user_id, min(user_id) OVER (PARTITION BY port ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM det) SELECT event_id FROM r WHERE best IS NOT NULL AND user_id < best")
def root_changes(spark, sf):
    w = Window.partitionBy("port").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return det(spark, sf).withColumn("best", F.min("user_id").over(w)).filter("user_id < best").select("event_id")


@register("I40_vni_enumeration", f"WITH {D} SELECT src, time_bucket(INTERVAL 7 DAY, ts) AS start, count(DISTINCT port) AS vnis FROM det GROUP BY 1, 2 HAVING count(DISTINCT port) >= 10")
def vni_enumeration(spark, sf):
    g = det(spark, sf).groupBy("src", F.window("ts", "7 days", startTime="4 days").alias("w")).agg(F.count_distinct("port").alias("vnis")).filter("vnis >= 10")
    return g.select("src", F.col("w.start").cast("timestamp_ntz").alias("start"), "vnis")


@register("I42_deauth_flood", f"WITH {D} SELECT port, time_bucket(INTERVAL 1 DAY, ts) AS start, round(count(*) / 24.0, 6) AS per_hour FROM det WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2")
def deauth_flood(spark, sf):
    g = det(spark, sf).filter("event_type = 'error'").groupBy("port", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return g.select("port", F.col("w.start").cast("timestamp_ntz").alias("start"), F.round(F.col("n") / 24.0, 6).alias("per_hour"))


@register("I43_beacon_flood", f"WITH {D} SELECT src, count(DISTINCT port) AS ssids FROM det GROUP BY 1 HAVING count(DISTINCT port) > 20")
def beacon_flood(spark, sf):
    return det(spark, sf).groupBy("src").agg(F.count_distinct("port").alias("ssids")).filter("ssids > 20")


@register("I44_evil_twin", f"WITH {D}, o AS (SELECT port, min_by(src, event_id) AS owner FROM det GROUP BY 1) SELECT event_id FROM det JOIN o USING (port) WHERE src <> owner AND severity = 3")
def evil_twin(spark, sf):
    d = det(spark, sf)
    owner = d.groupBy("port").agg(F.min_by("src", "event_id").alias("owner"))
    return d.filter("severity = 3").join(owner, "port").filter("src <> owner").select("event_id")


@register("I45_handshake", f"WITH {D} SELECT src, time_bucket(INTERVAL 1 DAY, ts) AS start, bit_or(1 << (port % 4)) AS mask FROM det GROUP BY 1, 2 HAVING bit_or(1 << (port % 4)) = 15")
def handshake(spark, sf):
    bit = F.pow(F.lit(2.0), F.col("port") % 4).cast("int")
    g = det(spark, sf).groupBy("src", F.window("ts", "1 day").alias("w")).agg(F.bit_or(bit).alias("mask")).filter("mask = 15")
    return g.select("src", F.col("w.start").cast("timestamp_ntz").alias("start"), "mask")


@register("I46_replay_counter", f"WITH {D}, l AS (SELECT event_id, port, lag(port) OVER (PARTITION BY src ORDER BY ts, event_id) AS was FROM det) SELECT event_id FROM l WHERE port <= was")
def replay_counter(spark, sf):
    w = Window.partitionBy("src").orderBy("us", "event_id")
    return det(spark, sf).withColumn("was", F.lag("port").over(w)).filter("port <= was").select("event_id")


@register("I52_ban_durations", f"WITH {D} SELECT event_id, CASE severity WHEN 3 THEN 86400 WHEN 2 THEN 3600 WHEN 1 THEN 300 ELSE 0 END AS seconds FROM det WHERE severity >= 1")
def ban_durations(spark, sf):
    table = F.create_map(*[F.lit(x) for kv in {0: 0, 1: 300, 2: 3600, 3: 86400}.items() for x in kv])
    return det(spark, sf).filter("severity >= 1").select("event_id", table[F.col("severity")].alias("seconds"))


@register("I31_fragment_overlap", f"""WITH {D}, f AS (SELECT event_id, user_id, port AS s, port + 10 AS e FROM det) SELECT a.event_id, count(b.event_id) AS overlaps FROM f a JOIN f b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.s < b.e AND a.e > b.s GROUP BY 1""")
def fragment_overlap(spark, sf):
    # ranges of one source overlap where starts are less than a length apart: a range frame counts them without pairs
    w = Window.partitionBy("user_id").orderBy("port").rangeBetween(-9, 9)
    return det(spark, sf).select("event_id", (F.count(F.lit(1)).over(w) - 1).alias("overlaps")).filter("overlaps > 0")


@register("I33_fragment_flood", f"WITH {D} SELECT src, count(*) FILTER (port % 3 = 0) AS incomplete, round(count(*) FILTER (port % 3 = 0) / count(*), 6) AS rate FROM det GROUP BY 1 HAVING count(*) FILTER (port % 3 = 0) > 10")
def fragment_flood(spark, sf):
    bad = F.count_if(F.col("port") % 3 == 0)
    return det(spark, sf).groupBy("src").agg(bad.alias("incomplete"), F.round(bad / F.count(F.lit(1)), 6).alias("rate")).filter("incomplete > 10")


@register("I62_volume_state", f"WITH {D} SELECT src, port % 10 AS flow, count(*) AS tx, count(DISTINCT port) AS rcpts FROM det GROUP BY 1, 2 HAVING count(*) >= 5 OR count(DISTINCT port) >= 5")
def volume_state(spark, sf):
    return det(spark, sf).groupBy("src", (F.col("port") % 10).alias("flow")).agg(F.count(F.lit(1)).alias("tx"), F.count_distinct("port").alias("rcpts")).filter("tx >= 5 OR rcpts >= 5")


@register("I59_ioc_cleanup", f"WITH {T.BANS} SELECT reason, count(*) AS kept FROM bans WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{T.NOW_BANS}' GROUP BY 1")
def ioc_cleanup(spark, sf):
    b = T.bans(spark, sf)
    return b.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(T.NOW_BANS).cast("timestamp"))).groupBy("reason").agg(F.count(F.lit(1)).alias("kept"))
