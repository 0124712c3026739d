"""Queries over bans, events and intelligence: point lookups, statistics, upserts, paging, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import tables as T
from .registry import register

D, B, I = T.DETECTIONS, T.BANS, T.INTEL  # noqa: E741


def _joined(spark, sf):
    d, i = T.detections(spark, sf), T.intel(spark, sf)
    return d.join(i, (d["user_id"] % 25) == i["ip_key"])  # the 25-row side is small by its schema; Catalyst broadcasts it


@register("C01_attack_countries", f"WITH {D}, {I} SELECT country_code, count(*) AS cnt FROM det JOIN intel ON user_id % 25 = ip_key WHERE country_code IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, country_code LIMIT 10")
def attack_countries(spark, sf):
    return R.top(R.count_by(_joined(spark, sf).filter("country_code IS NOT NULL"), "country_code"), 10, F.desc("cnt"), F.asc("country_code"))


@register("C02_attack_asns", f"WITH {D}, {I} SELECT as_org, count(*) AS cnt FROM det JOIN intel ON user_id % 25 = ip_key GROUP BY 1 ORDER BY cnt DESC, as_org LIMIT 10")
def attack_asns(spark, sf):
    return R.top(R.count_by(_joined(spark, sf), "as_org"), 10, F.desc("cnt"), F.asc("as_org"))


@register("C03_ban_enrichment", f"WITH {B}, {I} SELECT ban_id, ip, country_code, as_org FROM bans LEFT JOIN intel ON ip % 40 = ip_key")
def ban_enrichment(spark, sf):
    b, i = T.bans(spark, sf), T.intel(spark, sf)
    return b.join(i, (b["ip"] % 40) == i["ip_key"], "left").select("ban_id", "ip", "country_code", "as_org")


@register("C13_related_events", f"WITH {D} SELECT a.event_id, count(b.event_id) AS related FROM det a LEFT JOIN det b ON a.src = b.src AND a.event_id <> b.event_id GROUP BY 1")
def related_events(spark, sf):
    # every event of a source relates to all others of that source: a count per source says it without the self join
    d = T.detections(spark, sf)
    n = d.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return d.join(n, "src").select("event_id", (F.col("n") - 1).alias("related"))


@register("C27_ip_enrichment", f"WITH {D}, {I}, seen AS (SELECT user_id, count(*) AS n_events, max(ts) AS last_seen FROM det GROUP BY 1) SELECT user_id, n_events, last_seen, country_code, as_org, threat_score, c_mktsegment AS whois_org FROM seen LEFT JOIN intel ON user_id % 25 = ip_key LEFT JOIN customer ON user_id = c_custkey")
def ip_enrichment(spark, sf):
    seen = T.detections(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("last_seen"))
    i, c = T.intel(spark, sf), T.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("whois_org"))
    out = seen.join(i, (seen["user_id"] % 25) == i["ip_key"], "left").join(c, F.col("user_id") == F.col("c_custkey"), "left")
    return out.select("user_id", "n_events", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "country_code", "as_org", "threat_score", "whois_org")


@register("C28_host_union", "SELECT 'north' AS host, s_nationkey AS ip, count(*) AS bans FROM supplier GROUP BY 2 UNION ALL SELECT 'south', c_nationkey, count(*) FROM customer GROUP BY 2")
def host_union(spark, sf):
    a = R.count_by(T.table(spark, sf, "supplier").select(F.lit("north").alias("host"), F.col("s_nationkey").alias("ip")), "host", "ip", name="bans")
    b = R.count_by(T.table(spark, sf, "customer").select(F.lit("south").alias("host"), F.col("c_nationkey").alias("ip")), "host", "ip", name="bans")
    return a.unionByName(b)


@register("C29_outer_semi_anti", "SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'full', count(*) FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9000) a FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000) b ON c_nationkey = s_nationkey")
def outer_semi_anti(spark, sf):
    c, o, s = (T.table(spark, sf, t) for t in ("customer", "orders", "supplier"))
    n = F.count(F.lit(1)).alias("n")
    semi = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").agg(n).select(F.lit("semi").alias("kind"), "n")
    anti = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").agg(n).select(F.lit("anti").alias("kind"), "n")
    a = c.filter("c_acctbal > 9000").select("c_nationkey").distinct()
    b = s.filter("s_acctbal > 5000").select("s_nationkey").distinct()
    full = a.join(b, a["c_nationkey"] == b["s_nationkey"], "full").agg(n).select(F.lit("full").alias("kind"), "n")
    return semi.unionByName(anti).unionByName(full)


@register("D01_attack_statistics", f"""WITH {D}, {B}
SELECT (SELECT count(*) FROM bans) AS total_bans, (SELECT count(*) FROM bans WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{T.NOW_BANS}') AS active_bans,
       count(*) AS total_events, count(*) FILTER (ts >= TIMESTAMP '{T.NOW_EVENTS}' - INTERVAL 1 DAY) AS events_today, count(*) FILTER (ts >= TIMESTAMP '{T.NOW_EVENTS}' - INTERVAL 1 HOUR) AS events_hour FROM det""")
def attack_statistics(spark, sf):
    now = F.lit(T.NOW_EVENTS).cast("timestamp")
    e = T.detections(spark, sf).agg(F.count(F.lit(1)).alias("total_events"), F.count_if(F.col("ts") >= now - F.expr("INTERVAL 1 DAY")).alias("events_today"), F.count_if(F.col("ts") >= now - F.expr("INTERVAL 1 HOUR")).alias("events_hour"))
    live = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(T.NOW_BANS).cast("timestamp"))
    b = T.bans(spark, sf).agg(F.count(F.lit(1)).alias("total_bans"), F.count_if(live).alias("active_bans"))
    return b.join(e)  # one row each


@register("D02_events_by_service", f"WITH {D} SELECT port, count(*) AS cnt FROM det GROUP BY 1 ORDER BY 2 DESC")
def events_by_service(spark, sf):
    return R.count_by(T.detections(spark, sf), "port")


@register("D03_events_by_type", f"WITH {D} SELECT event_type, count(*) AS cnt FROM det GROUP BY 1")
def events_by_type(spark, sf):
    return R.count_by(T.detections(spark, sf), "event_type")


@register("D04_count_in_window", f"WITH {D} SELECT user_id, port, count(*) AS cnt FROM det WHERE ts > TIMESTAMP '{T.NOW_EVENTS}' - INTERVAL 7 DAY GROUP BY 1, 2")
def count_in_window(spark, sf):
    since = F.lit(T.NOW_EVENTS).cast("timestamp") - F.expr("INTERVAL 7 DAY")
    return R.count_by(T.detections(spark, sf).filter(F.col("ts") > since), "user_id", "port")


@register("D41_interval_stats", f"WITH {D} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, round(sum(value), 4) AS sum_us, count(*) AS n, max(value) AS max_us, round(avg(value), 6) AS avg_us FROM det GROUP BY 1")
def interval_stats(spark, sf):
    w = F.window("ts", "1 hour")
    out = T.detections(spark, sf).groupBy(w).agg(F.round(F.sum("value"), 4).alias("sum_us"), F.count(F.lit(1)).alias("n"), F.max("value").alias("max_us"), F.round(F.avg("value"), 6).alias("avg_us"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "sum_us", "n", "max_us", "avg_us")


@register("D44_host_totals", "SELECT count(*) AS hosts, count(*) FILTER (s_acctbal > 0) AS connected, round(sum(s_acctbal), 2) AS total_pps FROM supplier")
def host_totals(spark, sf):
    return T.table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("hosts"), F.count_if(F.col("s_acctbal") > 0).alias("connected"), F.round(F.sum("s_acctbal"), 2).alias("total_pps"))


@register("D45_source_counts", "SELECT source, count(*) AS cnt FROM documents GROUP BY 1")
def source_counts(spark, sf):
    return R.count_by(T.table(spark, sf, "documents"), "source")


@register("D46_partial_merge", "SELECT l_returnflag, l_linestatus, count(*) AS packets, round(sum(l_extendedprice), 2) AS bytes, max(l_tax) AS max_time FROM lineitem GROUP BY 1, 2")
def partial_merge(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("packets"), F.round(F.sum("l_extendedprice"), 2).alias("bytes"), F.max("l_tax").alias("max_time"))


@register("D47_cube_rollup", f"WITH {D} SELECT event_type, severity, count(*) AS cnt, count(DISTINCT user_id) AS sources FROM det GROUP BY CUBE (event_type, severity)")
def cube_rollup(spark, sf):
    return T.detections(spark, sf).cube("event_type", "severity").agg(F.count(F.lit(1)).alias("cnt"), F.count_distinct("user_id").alias("sources"))


@register("D56_filter_stats", f"WITH {B} SELECT count(*) FILTER (expires_at IS NULL) AS permanent, count(*) FILTER (expires_at > TIMESTAMP '{T.NOW_BANS}') AS temporary, count(*) FILTER (expires_at <= TIMESTAMP '{T.NOW_BANS}') AS lapsed, count(DISTINCT ip) AS addresses FROM bans")
def filter_stats(spark, sf):
    now = F.lit(T.NOW_BANS).cast("timestamp")
    e = F.col("expires_at")
    return T.bans(spark, sf).agg(F.count_if(e.isNull()).alias("permanent"), F.count_if(e > now).alias("temporary"), F.count_if(e <= now).alias("lapsed"), F.count_distinct("ip").alias("addresses"))


@register("B28_active_bans", f"WITH {B} SELECT ban_id, ip FROM bans WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{T.NOW_BANS}'")
def active_bans(spark, sf):
    return R.active(T.bans(spark, sf), T.NOW_BANS).select("ban_id", "ip")


@register("B29_expired_bans", f"WITH {B} SELECT ban_id, ip FROM bans WHERE expires_at IS NOT NULL AND expires_at <= TIMESTAMP '{T.NOW_BANS}'")
def expired_bans(spark, sf):
    return R.expired(T.bans(spark, sf), T.NOW_BANS).select("ban_id", "ip")


@register("B30_point_lookup", f"WITH {B} SELECT * FROM bans WHERE ip = 7")
def point_lookup(spark, sf):
    b = T.bans(spark, sf).filter("ip = 7")
    return b.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "expires_at")})


@register("B31_ban_list", f"WITH {B}, {I}, f AS (SELECT * FROM bans WHERE contains(CAST(ip AS VARCHAR), '12')) SELECT ban_id, ip, country_code, (SELECT count(*) FROM f) AS total FROM f LEFT JOIN intel ON ip % 40 = ip_key ORDER BY ban_id LIMIT 50")
def ban_list(spark, sf):
    f = T.bans(spark, sf).filter(F.col("ip").cast("string").contains("12"))
    page = R.top(f, 50, F.asc("ban_id"))  # the page is cut before it is enriched
    i, n = T.intel(spark, sf), f.agg(F.count(F.lit(1)).alias("total"))
    return page.join(i, (page["ip"] % 40) == i["ip_key"], "left").join(n).select("ban_id", "ip", "country_code", "total")


@register("B32_event_list", f"WITH {D}, page AS (SELECT * FROM det ORDER BY ts DESC, event_id DESC LIMIT 200 OFFSET 100) SELECT event_id, src, event_type FROM page WHERE event_type = 'error'")
def event_list(spark, sf):
    page = T.detections(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(200)
    return page.filter("event_type = 'error'").select("event_id", "src", "event_type")  # the filter follows the page: kept so


@register("B34_whitelist", f"WITH {B} SELECT ban_id, ip FROM bans WHERE ip NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def whitelist(spark, sf):
    safe = T.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    b = T.bans(spark, sf)
    return b.join(safe, b["ip"] == safe["c_custkey"], "left_anti").select("ban_id", "ip")


@register("B36_monitored_ports", f"WITH {D} SELECT port, count(*) AS cnt FROM det WHERE port NOT IN (22, 80, 43) GROUP BY 1")
def monitored_ports(spark, sf):
    return R.count_by(T.detections(spark, sf).filter(~F.col("port").isin(22, 80, 43)), "port")


@register("B43_severity_policy", f"WITH {D} SELECT src, max(severity) AS worst, CASE max(severity) WHEN 3 THEN 'immediate' WHEN 2 THEN 'threshold' ELSE 'alert' END AS policy FROM det GROUP BY 1")
def severity_policy(spark, sf):
    worst = T.detections(spark, sf).groupBy("src").agg(F.max("severity").alias("worst"))
    return R.flagged(worst, [(F.col("worst") == 3, "immediate"), (F.col("worst") == 2, "threshold")], "alert", "policy")


@register("A40_min_severity", f"WITH {D} SELECT event_id, severity FROM det WHERE severity >= 2")
def min_severity(spark, sf):
    return T.detections(spark, sf).filter("severity >= 2").select("event_id", "severity")


@register("F01_recent_events", f"WITH {D} SELECT event_id, src, event_type FROM det ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, sf):
    return R.top(T.detections(spark, sf), 50, F.desc("ts"), F.desc("event_id")).select("event_id", "src", "event_type")


@register("F02_recent_activity", f"WITH {B} SELECT ban_id, ip, reason FROM bans ORDER BY created_at DESC, ban_id DESC LIMIT 25")
def recent_activity(spark, sf):
    return R.top(T.bans(spark, sf), 25, F.desc("created_at"), F.desc("ban_id")).select("ban_id", "ip", "reason")


@register("F03_top_talkers", f"WITH {D} SELECT src, count(*) AS cnt FROM det GROUP BY 1 ORDER BY cnt DESC, src LIMIT 10")
def top_talkers(spark, sf):
    return R.top(R.count_by(T.detections(spark, sf), "src"), 10, F.desc("cnt"), F.asc("src"))


@register("F11_bottleneck", f"WITH {D} SELECT event_type AS stage, round(sum(value), 4) AS total_us FROM det GROUP BY 1 ORDER BY sum(value) DESC LIMIT 1")
def bottleneck(spark, sf):
    by = T.detections(spark, sf).groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("t"))
    return by.agg(F.max_by("stage", "t").alias("stage"), F.round(F.max("t"), 4).alias("total_us"))


@register("F12_paging", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def paging(spark, sf):
    return T.table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.asc("o_orderkey")).offset(40).limit(20).select("o_orderkey", "o_custkey")


@register("G03_ioc_upsert", "SELECT p_brand AS value, p_partkey AS ioc_id, p_type AS category FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS rn FROM part) WHERE rn = 1")
def ioc_upsert(spark, sf):
    p = T.table(spark, sf, "part")
    last = p.groupBy("p_brand").agg(F.max_by(F.struct("p_partkey", "p_type"), F.struct("p_retailprice", "p_partkey")).alias("v"))
    return last.select(F.col("p_brand").alias("value"), F.col("v.p_partkey").alias("ioc_id"), F.col("v.p_type").alias("category"))


@register("G04_ban_upsert", f"WITH {B} SELECT ip, reason, source, expires_at, first_at, ban_count FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY created_at DESC, ban_id DESC) AS rn, min(created_at) OVER (PARTITION BY ip) AS first_at, count(*) OVER (PARTITION BY ip) AS ban_count FROM bans) WHERE rn = 1")
def ban_upsert(spark, sf):
    out = R.upsert_counted(T.bans(spark, sf), "ip", "created_at", ["reason", "source", "expires_at"], "ban_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("expires_at", "first_at")})


@register("G05_intel_upsert", "SELECT l_suppkey AS ip, l_orderkey AS version, l_shipmode FROM (SELECT l_suppkey, l_orderkey, l_returnflag AS l_shipmode, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1")
def intel_upsert(spark, sf):
    li = T.table(spark, sf, "lineitem")
    last = li.groupBy("l_suppkey").agg(F.max_by(F.struct("l_orderkey", "l_returnflag"), F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("v"))
    return last.select(F.col("l_suppkey").alias("ip"), F.col("v.l_orderkey").alias("version"), F.col("v.l_returnflag").alias("l_shipmode"))


@register("G06_whitelist_edit", "SELECT c_custkey AS ip FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000")
def whitelist_edit(spark, sf):
    have = T.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("ip"))
    gone = T.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("ip"))
    new = T.table(spark, sf, "supplier").filter("s_acctbal > 9000").select(F.col("s_suppkey").alias("ip"))
    return have.join(gone, "ip", "left_anti").union(new).distinct()


@register("G07_source_replace", "SELECT doc_id, source FROM documents WHERE source <> 'src0'")
def source_replace(spark, sf):
    return T.table(spark, sf, "documents").filter("source <> 'src0'").select("doc_id", "source")


@register("G08_sync_diff", f"WITH {B}, a AS (SELECT DISTINCT ip FROM bans WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{T.NOW_BANS}'), b AS (SELECT DISTINCT ip FROM bans WHERE source = 'F') (SELECT ip, 'add' AS op FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT ip, 'remove' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))")
def sync_diff(spark, sf):
    b = T.bans(spark, sf)
    want, have = R.active(b, T.NOW_BANS).select("ip").distinct(), b.filter("source = 'F'").select("ip").distinct()
    both = want.withColumn("w", F.lit(1)).join(have.withColumn("h", F.lit(1)), "ip", "full")  # one join gives both differences
    return both.filter("w IS NULL OR h IS NULL").select("ip", F.when(F.col("h").isNull(), "add").otherwise("remove").alias("op"))


@register("G12_intersect_except", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def intersect_except(spark, sf):
    c, s = T.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), T.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    n = F.count(F.lit(1)).alias("n")
    return c.intersect(s).agg(n).select(F.lit("both").alias("kind"), "n").unionByName(c.subtract(s).agg(n).select(F.lit("only").alias("kind"), "n"))


@register("B06_ip_filter_verdict", f"""WITH {T.PACKETS} SELECT packet_id, CASE WHEN src_num % 17 = 3 THEN 'block_src' WHEN dst_num % 7 = 2 THEN 'block_dst' WHEN src_num % 25 IN (4, 9) THEN 'block_geo' WHEN src_num % 13 = 1 THEN 'watch' ELSE 'allow' END AS verdict FROM pkt""")
def ip_filter_verdict(spark, sf):
    s, d = F.col("src_num"), F.col("dst_num")
    cases = [(s % 17 == 3, "block_src"), (d % 7 == 2, "block_dst"), ((s % 25).isin(4, 9), "block_geo"), (s % 13 == 1, "watch")]
    return R.flagged(T.packets(spark, sf), cases, "allow", "verdict").select("packet_id", "verdict")


@register("B08_geo_predicate", f"WITH {D}, {I} SELECT event_id, coalesce(country_code IN ('NATION_1', 'NATION_2'), false) AS blocked, coalesce(country_code IN ('NATION_1', 'NATION_3'), true) AS allowed FROM det JOIN intel ON user_id % 25 = ip_key")
def geo_predicate(spark, sf):
    c = F.col("country_code")
    return _joined(spark, sf).select("event_id", F.coalesce(c.isin("NATION_1", "NATION_2"), F.lit(False)).alias("blocked"), F.coalesce(c.isin("NATION_1", "NATION_3"), F.lit(True)).alias("allowed"))


@register("E13_rank_functions", f"WITH {D} SELECT event_id, rank() OVER w AS rk, dense_rank() OVER w AS drk, ntile(4) OVER (PARTITION BY src ORDER BY ts) AS q, lead(event_id) OVER (PARTITION BY src ORDER BY ts) AS nxt, first_value(event_type) OVER (PARTITION BY src ORDER BY ts) AS first_type FROM det WINDOW w AS (PARTITION BY src ORDER BY severity DESC)")
def rank_functions(spark, sf):
    from pyspark.sql import Window

    w, t = Window.partitionBy("src").orderBy(F.desc("severity")), Window.partitionBy("src").orderBy("ts")
    out = T.detections(spark, sf).select("event_id", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("drk"), F.ntile(4).over(t).alias("q"), F.lead("event_id").over(t).alias("nxt"), F.first("event_type").over(t).alias("first_type"))
    return out.withColumns({c: F.col(c).cast("long") for c in ("rk", "drk", "q")})


@register("H51_port_category", f"WITH {D} SELECT port, CASE WHEN port IN (20, 21) THEN 'ftp' WHEN port = 22 THEN 'ssh' WHEN port = 23 THEN 'telnet' WHEN port = 25 THEN 'smtp' WHEN port = 53 THEN 'dns' WHEN port = 80 THEN 'http' WHEN port < 50 THEN 'well_known' ELSE 'other' END AS category, count(*) AS cnt FROM det GROUP BY 1, 2")
def port_category(spark, sf):
    p = F.col("port")
    cases = [(p.isin(20, 21), "ftp"), (p == 22, "ssh"), (p == 23, "telnet"), (p == 25, "smtp"), (p == 53, "dns"), (p == 80, "http"), (p < 50, "well_known")]
    return R.count_by(R.flagged(T.detections(spark, sf), cases, "other", "category"), "port", "category")


@register("H68_timestamps", f"WITH {D} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS rfc, epoch_us(ts) AS micros FROM det")
def timestamps(spark, sf):
    return T.detections(spark, sf).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("rfc"), F.unix_micros("ts").alias("micros"))


@register("H69_json_details", f"WITH {D} SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{{\"src\":\"' || 'u' || user_id || '\",\"severity\":' || CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END || '}}' AS details FROM events")
def json_details(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    d = T.detections(spark, sf).select("event_id", F.to_json(F.struct("src", "severity")).alias("details"))
    return e.join(d, "event_id").select("event_id", F.col("p.k").alias("k"), "details")


@register("D24_priority_sla", f"WITH {D} SELECT event_id, CASE severity WHEN 3 THEN 'P1' WHEN 2 THEN 'P2' WHEN 1 THEN 'P3' ELSE 'P4' END AS priority, CASE severity WHEN 3 THEN 15 WHEN 2 THEN 60 WHEN 1 THEN 240 ELSE 1440 END AS sla_minutes, least(severity + 1, 4) AS elevated FROM det")
def priority_sla(spark, sf):
    s = F.col("severity")
    return T.detections(spark, sf).select("event_id", F.when(s == 3, "P1").when(s == 2, "P2").when(s == 1, "P3").otherwise("P4").alias("priority"), F.when(s == 3, 15).when(s == 2, 60).when(s == 1, 240).otherwise(1440).alias("sla_minutes"), F.least(s + 1, F.lit(4)).alias("elevated"))


@register("I60_ban_cleanup", f"WITH {B} SELECT ip, count(*) FILTER (expires_at IS NULL OR expires_at > TIMESTAMP '{T.NOW_BANS}') AS kept, count(*) FILTER (expires_at <= TIMESTAMP '{T.NOW_BANS}') AS removed FROM bans GROUP BY 1")
def ban_cleanup(spark, sf):
    gone = F.coalesce(F.col("expires_at") <= F.lit(T.NOW_BANS).cast("timestamp"), F.lit(False))
    return T.bans(spark, sf).groupBy("ip").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("removed"))
