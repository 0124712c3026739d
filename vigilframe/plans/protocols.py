"""Queries over log lines, rule predicates by protocol, audit formats and the remaining features and state.

Log lines are written from detections first and then parsed, so their oracle is the table they came from.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import anomaly as A
from ..operators import flows as X
from ..operators import lookups as L
from ..operators import relational as R
from ..operators import stateful as S
from ..operators import textscan as TS
from ..sources import tables as T
from .registry import register

D, P = T.DETECTIONS, T.PACKETS
IP = "'192.168.0.' || (user_id % 256)"


def det(spark, sf):
    d = T.detections(spark, sf)
    return d.withColumn("us", F.unix_micros("ts")).withColumn("ip", F.concat(F.lit("192.168.0."), (F.col("user_id") % 256).cast("string")))


def service_lines(spark, sf):
    """sshd, postfix and web-server error lines, by event type."""
    stamp = F.date_format("ts", "MMM d HH:mm:ss")
    body = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("sshd[1]: Failed password for root from "), "ip", F.lit(" port 22 ssh2")))
        .when(F.col("event_type") == "view", F.concat(F.lit("sshd[1]: Invalid user bob from "), "ip"))
        .when(F.col("event_type") == "click", F.concat(F.lit("postfix/smtpd[2]: warning: unknown["), "ip", F.lit("]: SASL LOGIN authentication failed")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("nginx: access forbidden by rule, client: "), "ip"))
        .otherwise("cron: nothing to see")
    )
    return det(spark, sf).select("event_id", F.concat(stamp, F.lit(" host "), body).alias("line"))


@register("H01_log_match", f"WITH {D} SELECT event_id, CASE event_type WHEN 'click' THEN 'postfix' WHEN 'signup' THEN 'nginx_error' ELSE 'ssh' END AS service, CASE event_type WHEN 'error' THEN 'failed_password' WHEN 'view' THEN 'invalid_user' WHEN 'click' THEN 'sasl_failure' ELSE 'forbidden' END AS kind, {IP} AS ip FROM det WHERE event_type <> 'purchase'")
def log_match(spark, sf):
    m = service_lines(spark, sf).withColumn("m", TS.match_log(F.col("line"))).filter("m IS NOT NULL")
    return m.select("event_id", "m.service", F.col("m.event_type").alias("kind"), "m.ip")


@register("H02_sshd_parser", f"WITH {D} SELECT event_id, {IP} AS ip, date_trunc('second', ts) AS at FROM det WHERE event_type IN ('error', 'view')")
def sshd_parser(spark, sf):
    m = service_lines(spark, sf).withColumn("m", TS.match_log(F.col("line"))).filter("m.service = 'ssh'")
    return m.select("event_id", "m.ip", TS.syslog_time(F.col("line"), 2024).cast("timestamp_ntz").alias("at"))


@register("H05_postfix_parser", f"WITH {D} SELECT event_id, {IP} AS ip FROM det WHERE event_type = 'click'")
def postfix_parser(spark, sf):
    m = service_lines(spark, sf).withColumn("m", TS.match_log(F.col("line"))).filter("m.service = 'postfix'")
    return m.select("event_id", "m.ip")


@register("H04_nginx_error_parser", f"WITH {D} SELECT event_id, {IP} AS ip FROM det WHERE event_type = 'signup'")
def nginx_error_parser(spark, sf):
    m = service_lines(spark, sf).withColumn("m", TS.match_log(F.col("line"))).filter("m.service = 'nginx_error'")
    return m.select("event_id", "m.ip")


@register("H03_nginx_access_parser", f"WITH {D} SELECT event_id, {IP} AS ip, 200 + port AS status, CASE event_type WHEN 'error' THEN 'sql_injection' WHEN 'view' THEN 'path_traversal' WHEN 'click' THEN 'sensitive_file' WHEN 'signup' THEN 'scanner' END AS kind FROM det")
def nginx_access_parser(spark, sf):
    t = F.col("event_type")
    url = F.when(t == "error", "/a?q=1+union+select").when(t == "view", "/../../x").when(t == "click", "/.env").otherwise("/ok")
    agent = F.when(t == "signup", "Nikto/2").otherwise("Mozilla")
    line = F.concat("ip", F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), url, F.lit(' HTTP/1.1" '), (F.col("port") + 200).cast("string"), F.lit(' 12 "-" "'), agent, F.lit('"'))
    return det(spark, sf).select("event_id", TS.access_log(line).alias("a")).select("event_id", "a.ip", "a.status", "a.kind")


@register("H67_real_client", f"WITH {D} SELECT event_id, CASE WHEN port % 2 = 0 THEN {IP} ELSE '8.8.8.8' END AS client FROM det")
def real_client(spark, sf):
    head = F.when(F.col("port") % 2 == 0, F.concat(F.lit("10.0.0.1, "), "ip", F.lit(", 10.0.0.2"))).otherwise("8.8.8.8, 10.0.0.1")
    return det(spark, sf).select("event_id", TS.real_client(head, F.array(F.lit("10.0.0.1"), F.lit("10.0.0.2"))).alias("client"))


@register("H06_expected_detection", f"WITH {D} SELECT event_id, CASE event_type WHEN 'error' THEN 'brute_force' WHEN 'view' THEN 'scan' WHEN 'click' THEN 'web_attack' WHEN 'purchase' THEN 'dos' END AS expected, CASE event_type WHEN 'error' THEN 9 WHEN 'view' THEN 4 WHEN 'click' THEN 6 WHEN 'purchase' THEN 8 ELSE 0 END AS score FROM det")
def expected_detection(spark, sf):
    kind = F.create_map(*[F.lit(x) for kv in {"error": "brute_force", "view": "scan", "click": "web_attack", "purchase": "dos"}.items() for x in kv])
    score = F.create_map(*[F.lit(x) for kv in {"error": 9, "view": 4, "click": 6, "purchase": 8}.items() for x in kv])
    return det(spark, sf).select("event_id", kind[F.col("event_type")].alias("expected"), F.coalesce(score[F.col("event_type")], F.lit(0)).alias("score"))


@register("H10_attack_mapping", f"WITH {D} SELECT event_id, CASE WHEN event_type LIKE '%err%' THEN 'fault' WHEN event_type LIKE '%c%' THEN 'commerce' ELSE 'any' END AS family FROM det")
def attack_mapping(spark, sf):
    t = F.lower("event_type")
    return R.flagged(det(spark, sf), [(t.contains("err"), "fault"), (t.contains("c"), "commerce")], "any", "family").select("event_id", "family")


@register("H13_threat_message", f"WITH {D} SELECT event_id, event_type || ' from ' || src || ' on port ' || port AS message, CASE WHEN severity >= 3 THEN 'drop' WHEN severity = 2 THEN 'rate_limit' ELSE 'log' END AS action FROM det")
def threat_message(spark, sf):
    s = F.col("severity")
    return det(spark, sf).select("event_id", F.format_string("%s from %s on port %d", "event_type", "src", "port").alias("message"), F.when(s >= 3, "drop").when(s == 2, "rate_limit").otherwise("log").alias("action"))


@register("H16_estimates", f"WITH {P}, a AS (SELECT src_num, count(*) AS n, count(DISTINCT dst_port) AS ports, count(DISTINCT dst_num) AS hosts FROM pkt GROUP BY 1) SELECT src_num, CAST(round(least(1.0, ports / 1000) * 1000) AS INTEGER) AS ports, CAST(round(least(1.0, hosts / 100) * 100) AS INTEGER) AS hosts, CASE WHEN ports >= 5 THEN 'multi' ELSE 'single' END AS services FROM a")
def estimates(spark, sf):
    a = T.packets(spark, sf).groupBy("src_num").agg(F.count_distinct("dst_port").alias("p"), F.count_distinct("dst_num").alias("h"))
    return a.select("src_num", F.round(X.cap(F.col("p") / 1000) * 1000).cast("int").alias("ports"), F.round(X.cap(F.col("h") / 100) * 100).cast("int").alias("hosts"), F.when(F.col("p") >= 5, "multi").otherwise("single").alias("services"))


@register("H29_random_local", "SELECT page_id, round(len(regexp_extract_all(url, '[a-z][0-9]|[0-9][a-z]')) / length(url), 6) AS transitions FROM pages")
def random_local(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", F.round(F.try_divide(F.size(F.regexp_extract_all("url", F.lit("[a-z][0-9]|[0-9][a-z]"), 0)), F.length("url")), 6).alias("transitions"))


MAIL = "SELECT conv_id, count(*) AS parts, count(*) FILTER (role = 'user') AS senders, max(length(text)) AS longest, bool_or(contains(lower(text), 'free')) AS promo FROM conversations GROUP BY 1"


def mails(spark, sf):
    return T.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("role") == "user").alias("senders"), F.max(F.length("text")).alias("longest"), F.bool_or(F.lower("text").contains("free")).alias("promo"))


@register("H33_mail_checks", f"WITH m AS ({MAIL}) SELECT conv_id, senders = 0 AS no_sender, parts > 20 AS many_hops, senders * 2 < parts AND NOT promo AS spoofed, promo OR longest > 2000 AS spam FROM m")
def mail_checks(spark, sf):
    c = F.col
    return mails(spark, sf).select("conv_id", (c("senders") == 0).alias("no_sender"), (c("parts") > 20).alias("many_hops"), ((c("senders") * 2 < c("parts")) & ~c("promo")).alias("spoofed"), (c("promo") | (c("longest") > 2000)).alias("spam"))


@register("B47_smtp_alerts", f"WITH m AS ({MAIL}), a AS (SELECT conv_id, unnest(list_filter([CASE WHEN promo THEN 'spam' END, CASE WHEN parts >= 4 THEN 'volume' END, CASE WHEN longest > 1500 THEN 'attachment' END], lambda x: x IS NOT NULL)) AS alert FROM m) SELECT * FROM a")
def smtp_alerts(spark, sf):
    a = F.array(F.when(F.col("promo"), "spam"), F.when(F.col("parts") >= 4, "volume"), F.when(F.col("longest") > 1500, "attachment"))
    return mails(spark, sf).select("conv_id", F.explode(F.array_compact(a)).alias("alert"))


@register("I27_open_relay", "SELECT conv_id, bool_and(role <> 'user' OR length(text) > 50) AND count(*) > 1 AS relay FROM conversations GROUP BY 1")
def open_relay(spark, sf):
    fine = F.bool_and((F.col("role") != "user") | (F.length("text") > 50))
    return T.table(spark, sf, "conversations").groupBy("conv_id").agg((fine & (F.count(F.lit(1)) > 1)).alias("relay"))


SRC = "a AS (SELECT src, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, count(DISTINCT port) AS names, max(value) AS top FROM det GROUP BY 1)"


def by_src(spark, sf):
    return det(spark, sf).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"), F.count_distinct("port").alias("names"), F.max("value").alias("top"))


def alerts(df, cases: dict):
    return df.select("src", F.explode(F.array_compact(F.array(*[F.when(c, name) for name, c in cases.items()]))).alias("alert"))


def alerts_sql(cases: dict) -> str:
    return f"WITH {D}, {SRC} SELECT src, unnest(list_filter([{', '.join(f'''CASE WHEN {c} THEN '{n}' END''' for n, c in cases.items())}], lambda x: x IS NOT NULL)) AS alert FROM a"


DNS = {"exfiltration": "top > 450", "nxdomain": "failures > 0.25 * n", "flood": "n > 60"}
SSH = {"auth_failures": "failures >= 12", "old_version": "names % 3 = 0"}
SMB = {"auth_failures": "failures >= 15", "lateral": "names > 45", "ransomware": "n > 70 AND top > 480"}
TLS = {"downgrade": "names % 2 = 0 AND top > 300", "known_client": "n % 7 = 0"}


def _protocol(name, cases):
    @register(name, alerts_sql(cases))
    def query(spark, sf):
        return alerts(by_src(spark, sf), {k: F.expr(v) for k, v in cases.items()})

    return query


dns_alerts, ssh_alerts, smb_alerts, tls_alerts = (_protocol(n, c) for n, c in (("B45_dns_alerts", DNS), ("B46_ssh_alerts", SSH), ("B48_smb_alerts", SMB), ("B49_tls_alerts", TLS)))


@register("B50_buffer_rules", "SELECT page_id, 'http_uri' AS buffer FROM pages WHERE contains(url, 'page=') UNION ALL SELECT page_id, 'http_host' FROM pages WHERE contains(regexp_extract(url, '^https?://([^/:?]+)', 1), 'th') UNION ALL SELECT page_id, 'body' FROM pages WHERE contains(html, '<table')")
def buffer_rules(spark, sf):
    p = T.table(spark, sf, "pages")
    buffers = F.create_map(F.lit("http_uri"), F.col("url"), F.lit("http_host"), F.regexp_extract("url", r"^https?://([^/:?]+)", 1), F.lit("body"), F.col("html"))
    rules = {"http_uri": "page=", "http_host": "th", "body": "<table"}
    hit = F.array_compact(F.array(*[F.when(buffers[F.lit(b)].contains(c), b) for b, c in rules.items()]))
    return p.select("page_id", F.explode(hit).alias("buffer"))


@register("B26_verdict", f"WITH {D} SELECT event_id FROM det WHERE severity IN (2, 3) AND port < 50")
def verdict(spark, sf):
    action = F.when(F.col("severity") == 3, "drop").when(F.col("severity") == 2, "reject").otherwise("alert")
    return det(spark, sf).withColumn("a", action).filter(F.col("a").isin("drop", "reject") & (F.col("port") < 50)).select("event_id")


@register("B55_incident_status", "SELECT o_orderkey, o_orderstatus IN ('O', 'P') AS open, o_orderstatus = 'F' AS closed FROM orders")
def incident_status(spark, sf):
    s = F.col("o_orderstatus")
    return T.table(spark, sf, "orders").select("o_orderkey", s.isin("O", "P").alias("open"), (s == "F").alias("closed"))


@register("B54_ioc_expiry", f"WITH {T.BANS} SELECT ban_id, coalesce(expires_at < TIMESTAMP '{T.NOW_BANS}', false) AS lapsed FROM bans")
def ioc_expiry(spark, sf):
    return T.bans(spark, sf).select("ban_id", F.coalesce(F.col("expires_at") < F.lit(T.NOW_BANS).cast("timestamp"), F.lit(False)).alias("lapsed"))


@register("B20_pcre_flags", "SELECT doc_id, regexp_matches(text, '(?i)^the') AS i, regexp_matches(text, '(?s)e.*z') AS s, regexp_matches(text, '(?m)^[A-Z]') AS m FROM documents")
def pcre_flags(spark, sf):
    t = F.col("text")
    return T.table(spark, sf, "documents").select("doc_id", t.rlike("(?i)^the").alias("i"), t.rlike("(?s)e.*z").alias("s"), t.rlike("(?m)^[A-Z]").alias("m"))


@register("B25_loose_match", "SELECT doc_id FROM documents WHERE contains(text, 'on') AND contains(text, 'er') AND NOT contains(text, 'zz')")
def loose_match(spark, sf):
    """Contents anywhere, none of the negated ones; no header, position or state."""
    t = F.col("text")
    return T.table(spark, sf, "documents").filter(t.contains("on") & t.contains("er") & ~t.contains("zz")).select("doc_id")


@register("D43_dns_enumeration", f"WITH {D} SELECT src, count(DISTINCT port) AS names, max(c) AS widest FROM (SELECT src, port, count(*) OVER (PARTITION BY src, port // 10) AS c FROM (SELECT DISTINCT src, port FROM det)) GROUP BY 1 HAVING count(DISTINCT port) > 20 AND max(c) > 4")
def dns_enumeration(spark, sf):
    g = det(spark, sf).select("src", "port").distinct().groupBy("src", F.floor(F.col("port") / 10).alias("parent")).agg(F.count(F.lit(1)).alias("c"))
    return g.groupBy("src").agg(F.sum("c").alias("names"), F.max("c").alias("widest")).filter("names > 20 AND widest > 4")


@register("D49_fragment_features", f"WITH {P} SELECT src_num, round(avg(CASE WHEN size % 5 = 0 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(CASE WHEN size < 28 THEN 1.0 ELSE 0.0 END), 6) AS tiny FROM pkt GROUP BY 1")
def fragment_features(spark, sf):
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return T.packets(spark, sf).groupBy("src_num").agg(share(F.col("size") % 5 == 0).alias("rate"), share(F.col("size") < 28).alias("tiny"))


@register("D51_icmp_features", f"WITH {P} SELECT src_num, count(*) AS n, round(avg(CASE WHEN size % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS redirect, round(avg(CASE WHEN size % 3 = 1 THEN 1.0 ELSE 0.0 END), 6) AS unreachable FROM pkt WHERE proto = 1 GROUP BY 1")
def icmp_features(spark, sf):
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return T.packets(spark, sf).filter("proto = 1").groupBy("src_num").agg(F.count(F.lit(1)).alias("n"), share(F.col("size") % 3 == 0).alias("redirect"), share(F.col("size") % 3 == 1).alias("unreachable"))


@register("D57_storage_stats", "SELECT count(DISTINCT p_brand) AS sets, count(DISTINCT p_brand) FILTER (p_size > 25) AS enabled, count(*) AS rules FROM part")
def storage_stats(spark, sf):
    return T.table(spark, sf, "part").agg(F.count_distinct("p_brand").alias("sets"), F.count_distinct(F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("enabled"), F.count(F.lit(1)).alias("rules"))


@register("D59_baseline_summary", f"WITH {D} SELECT count(*) AS samples, count(DISTINCT port) AS services, date_diff('second', min(ts), max(ts)) AS seconds FROM det")
def baseline_summary(spark, sf):
    return det(spark, sf).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("port").alias("services"), (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("seconds"))


@register("E03_range_prune", f"WITH {D} SELECT event_id, min(epoch_us(ts)) OVER (PARTITION BY src ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS oldest FROM det")
def range_prune(spark, sf):
    return det(spark, sf).select("event_id", F.min("us").over(S.range_window(["src"], 86_400_000_000)).alias("oldest"))


@register("F05_deviation_ranking", "WITH b AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem), z AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs((l_quantity - m) / s) AS z FROM lineitem, b) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(z, 6) AS z FROM z ORDER BY round(z, 6) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20")
def deviation_ranking(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    j = li.join(F.broadcast(A.profile(li, [], ["l_quantity"])))
    z = F.round(F.abs(A.zscore(F.col("l_quantity"), F.col("l_quantity_mean"), F.col("l_quantity_std"))), 6).alias("z")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", z).orderBy(F.desc("z"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(20)


@register("F06_feature_importance", "WITH p AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT CAST(i AS INTEGER) AS feature, round(var_samp(x), 5) AS importance FROM p GROUP BY 1 ORDER BY round(var_samp(x), 5) DESC, 1 LIMIT 5")
def feature_importance(spark, sf):
    p = T.table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("feature", "x"))
    v = p.groupBy("feature").agg(F.round(F.var_samp(F.col("x").cast("double")), 5).alias("importance"))
    return v.orderBy(F.desc("importance"), F.asc("feature")).limit(5)


@register("F09_evict_oldest", f"WITH {D} SELECT src, max(epoch_us(ts)) AS last_us FROM det GROUP BY 1 ORDER BY 2, 1 LIMIT 3")
def evict_oldest(spark, sf):
    return det(spark, sf).groupBy("src").agg(F.max("us").alias("last_us")).orderBy("last_us", "src").limit(3)


@register("F08_rag_top_k", "WITH q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), j AS (SELECT q_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS c FROM embeddings, q WHERE vec_id <> q_id), b AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY c DESC, vec_id) AS rn FROM j) SELECT q_id, vec_id FROM b WHERE rn <= 3 AND c >= 0.2")
def rag_top_k(spark, sf):
    e = T.table(spark, sf, "embeddings")
    return L.knn(e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "q_id"), e, 3, "q_id", "vec_id", "embedding").filter("score >= 0.2").select("q_id", "vec_id")


@register("G01_feed_union", "SELECT kind, value, count(*) AS feeds FROM (SELECT 'user' AS kind, c_name AS value FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'user', c_name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'host', s_name FROM supplier) GROUP BY 1, 2")
def feed_union(spark, sf):
    c, s = T.table(spark, sf, "customer"), T.table(spark, sf, "supplier")
    one = lambda df, kind, col: df.select(F.lit(kind).alias("kind"), F.col(col).alias("value"))
    every = one(c.filter("c_acctbal < 0"), "user", "c_name").unionByName(one(c.filter("c_mktsegment = 'BUILDING'"), "user", "c_name")).unionByName(one(s, "host", "s_name"))
    return every.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("feeds"))


@register("G02_ruleset_merge", "SELECT p_brand AS ruleset, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rule_id FROM part")
def ruleset_merge(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return T.table(spark, sf, "part").select(F.col("p_brand").alias("ruleset"), "p_partkey", F.row_number().over(w).cast("long").alias("rule_id"))


@register("G11_vector_merge", f"WITH {D}, a AS (SELECT src, max(value) FILTER (event_type = 'error') AS x, max(value) FILTER (event_type = 'view') AS y FROM det GROUP BY 1) SELECT src, coalesce(x, y, 0) AS merged, CASE WHEN x IS NULL THEN 0 ELSE 1 END + CASE WHEN y IS NULL THEN 0 ELSE 2 END AS mask FROM a")
def vector_merge(spark, sf):
    t, v = F.col("event_type"), F.col("value")
    a = det(spark, sf).groupBy("src").agg(F.max(F.when(t == "error", v)).alias("x"), F.max(F.when(t == "view", v)).alias("y"))
    return a.select("src", F.coalesce("x", "y", F.lit(0.0)).alias("merged"), (F.when(F.col("x").isNull(), 0).otherwise(1) + F.when(F.col("y").isNull(), 0).otherwise(2)).alias("mask"))


@register("H59_modified_z", "WITH m AS (SELECT median(l_quantity) AS med FROM lineitem), d AS (SELECT median(abs(l_quantity - med)) AS mad FROM lineitem, m) SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - med) / (1.4826 * mad), 6) AS z FROM lineitem, m, d")
def modified_z(spark, sf):
    li = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    med = F.lit(A.median(li, "l_quantity")).cast("double")
    away = li.withColumn("away", F.abs(F.col("l_quantity") - med))
    mad = F.lit(A.median(away, "away")).cast("double")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.try_divide(F.col("l_quantity") - med, 1.4826 * mad), 6).alias("z"))


@register("H83_port_mismatch", f"WITH {P} SELECT packet_id, CASE WHEN proto = 17 AND least(src_port, dst_port) NOT IN (53, 123) THEN true WHEN proto = 6 AND least(src_port, dst_port) = 53 THEN true ELSE false END AS mismatch FROM pkt")
def port_mismatch(spark, sf):
    low, proto = F.least("src_port", "dst_port"), F.col("proto")
    return T.packets(spark, sf).select("packet_id", (((proto == 17) & ~low.isin(53, 123)) | ((proto == 6) & (low == 53))).alias("mismatch"))


@register("H82_protocol_probe", f"WITH {P} SELECT packet_id, CASE WHEN dst_port IN (80, 8080) THEN 'http' WHEN dst_port = 443 THEN 'tls' WHEN dst_port = 22 THEN 'ssh' WHEN size > 250 THEN 'bulk' ELSE 'raw' END AS probe FROM pkt")
def protocol_probe(spark, sf):
    d = F.col("dst_port")
    options = [(90, d.isin(80, 8080), "http"), (80, d == 443, "tls"), (70, d == 22, "ssh"), (20, F.col("size") > 250, "bulk"), (1, F.lit(True), "raw")]
    best = F.array_max(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("n"), F.lit(s).alias("s"))) for n, c, s in options])))
    return T.packets(spark, sf).select("packet_id", best["s"].alias("probe"))


@register("H93_wifi_channel", "SELECT p_partkey, CASE WHEN f BETWEEN 2412 AND 2472 THEN CAST((f - 2407) // 5 AS INTEGER) WHEN f = 2484 THEN 14 WHEN f BETWEEN 5170 AND 5825 THEN CAST((f - 5000) // 5 AS INTEGER) ELSE 0 END AS channel FROM (SELECT p_partkey, 2400 + p_size * 73 AS f FROM part)")
def wifi_channel(spark, sf):
    f = F.col("f")
    p = T.table(spark, sf, "part").select("p_partkey", (F.lit(2400) + F.col("p_size") * 73).alias("f"))
    return p.select("p_partkey", F.when(f.between(2412, 2472), F.floor((f - 2407) / 5)).when(f == 2484, 14).when(f.between(5170, 5825), F.floor((f - 5000) / 5)).otherwise(0).cast("int").alias("channel"))


@register("H96_tls_version", "SELECT p_partkey, CASE 768 + p_size % 6 WHEN 768 THEN 'SSL 3.0' WHEN 769 THEN 'TLS 1.0' WHEN 770 THEN 'TLS 1.1' WHEN 771 THEN 'TLS 1.2' WHEN 772 THEN 'TLS 1.3' ELSE 'unknown' END AS version, p_size % 6 < 3 AS weak FROM part")
def tls_version(spark, sf):
    names = F.create_map(*[F.lit(x) for kv in {768: "SSL 3.0", 769: "TLS 1.0", 770: "TLS 1.1", 771: "TLS 1.2", 772: "TLS 1.3"}.items() for x in kv])
    return T.table(spark, sf, "part").select("p_partkey", F.coalesce(names[F.lit(768) + F.col("p_size") % 6], F.lit("unknown")).alias("version"), (F.col("p_size") % 6 < 3).alias("weak"))


@register("I11_reassembly", "SELECT conv_id, role, md5(substr(string_agg(text, '' ORDER BY turn), 1, 65536)) AS stream FROM conversations GROUP BY 1, 2")
def reassembly(spark, sf):
    """Segments of each direction joined in order, at most 64 KB; a conversation's length bounds what is gathered."""
    s = T.table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    return s.select("conv_id", "role", F.md5(F.substring(F.array_join(F.transform("s", lambda x: x["text"]), ""), 1, 65536).cast("binary")).alias("stream"))


@register("I22_covert_channel", f"WITH {D} SELECT event_id, count(*) OVER (PARTITION BY src ORDER BY epoch_us(ts) RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW) > 3 AS rate, value > 450 AS large FROM det")
def covert_channel(spark, sf):
    return det(spark, sf).select("event_id", (F.count(F.lit(1)).over(S.range_window(["src"], 43_200_000_000)) > 3).alias("rate"), (F.col("value") > 450).alias("large"))


@register("I38_neighbour_change", f"WITH {D}, l AS (SELECT event_id, port, user_id % 5 AS mac, lag(user_id % 5) OVER (PARTITION BY port ORDER BY ts, event_id) AS was FROM det) SELECT event_id, was IS NULL AS new_device, coalesce(mac <> was, false) AS changed FROM l")
def neighbour_change(spark, sf):
    was = F.lag(F.col("user_id") % 5).over(Window.partitionBy("port").orderBy("us", "event_id"))
    return det(spark, sf).select("event_id", was.isNull().alias("new_device"), F.coalesce(F.col("user_id") % 5 != was, F.lit(False)).alias("changed"))


@register("I34_icmp_floods", f"WITH {P} SELECT src_num, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM pkt WHERE proto = 1 GROUP BY 1, 2 HAVING count(*) >= 2")
def icmp_floods(spark, sf):
    g = T.packets(spark, sf).filter("proto = 1").groupBy("src_num", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return g.select("src_num", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@register("I41_port_macs", f"WITH {D} SELECT port, count(DISTINCT user_id) AS macs FROM det GROUP BY 1 HAVING count(DISTINCT user_id) > 2")
def port_macs(spark, sf):
    return det(spark, sf).groupBy("port").agg(F.count_distinct("user_id").alias("macs")).filter("macs > 2")


@register("I47_latest_state", f"WITH {D} SELECT src, max_by(event_type, event_id) AS last_type, max_by(port, event_id) AS last_port FROM det GROUP BY 1")
def latest_state(spark, sf):
    return det(spark, sf).groupBy("src").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max_by("port", "event_id").alias("last_port"))


@register("I48_sequences", f"WITH {D} SELECT event_id, len(list(value) OVER (PARTITION BY src ORDER BY epoch_us(ts) RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW)) AS n, round(list_sum(list(value) OVER (PARTITION BY src ORDER BY epoch_us(ts) RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW)), 4) AS total FROM det")
def sequences(spark, sf):
    w = S.range_window(["src"], 172_800_000_000)
    return det(spark, sf).select("event_id", F.count("value").over(w).alias("n"), F.round(F.sum("value").over(w), 4).alias("total"))


@register("I63_lateral_state", f"WITH {D} SELECT src, bool_or(port > 90) AND count(DISTINCT port) > 20 AS lateral, count(*) FILTER (value > 300) > 5 AS ransomware FROM det GROUP BY 1")
def lateral_state(spark, sf):
    return det(spark, sf).groupBy("src").agg((F.bool_or(F.col("port") > 90) & (F.count_distinct("port") > 20)).alias("lateral"), (F.count_if(F.col("value") > 300) > 5).alias("ransomware"))


@register("I57_log_window", f"WITH {D} SELECT event_id FROM det WHERE ts >= TIMESTAMP '{T.NOW_EVENTS}' - INTERVAL 5 DAY")
def log_window(spark, sf):
    return det(spark, sf).filter(F.col("ts") >= F.lit(T.NOW_EVENTS).cast("timestamp") - F.expr("INTERVAL 5 DAY")).select("event_id")


@register("K07_engine_decision", f"WITH {D}, s AS (SELECT event_id, 0.6 * (value / 500) + 0.4 * (port / 100.0) AS score FROM det) SELECT event_id, round(score, 6) AS score FROM s WHERE score >= 0.6")
def engine_decision(spark, sf):
    score = 0.6 * (F.col("value") / 500) + 0.4 * (F.col("port") / 100.0)
    return det(spark, sf).select("event_id", score.alias("s")).filter("s >= 0.6").select("event_id", F.round("s", 6).alias("score"))


@register("K12_statistical_score", f"WITH {D}, b AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM det) SELECT event_id, round(0.6 * least(abs((value - m) / s) / 3, 1.0) + 0.4 * CASE WHEN abs((value - m) / s) > 2 THEN 1 ELSE 0 END, 6) AS score FROM det, b")
def statistical_score(spark, sf):
    d = det(spark, sf)
    j = d.join(F.broadcast(A.profile(d, [], ["value"])))
    z = F.abs(A.zscore(F.col("value"), F.col("value_mean"), F.col("value_std")))
    return j.select("event_id", F.round(0.6 * A.squash(z, 3.0) + 0.4 * F.when(z > 2, 1).otherwise(0), 6).alias("score"))


@register("K15_temporal", f"WITH {D}, w AS (SELECT event_id, abs(value - avg(value) OVER (PARTITION BY src ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) AS d FROM det) SELECT event_id, coalesce(d > 200, false) AS anomaly FROM w")
def temporal(spark, sf):
    w = Window.partitionBy("src").orderBy("us", "event_id").rowsBetween(-5, -1)
    return det(spark, sf).select("event_id", F.coalesce(F.abs(F.col("value") - F.avg("value").over(w)) > 200, F.lit(False)).alias("anomaly"))


@register("K19_adjuster", f"WITH {D}, r AS (SELECT event_type, avg(CASE WHEN port < 30 THEN 1.0 ELSE 0.0 END) AS fp, avg(CASE WHEN port > 80 THEN 1.0 ELSE 0.0 END) AS fn FROM det GROUP BY 1) SELECT event_type, CAST(round(least(0.95, greatest(0.3, 0.7 + CASE WHEN fp > 0.05 THEN 0.05 ELSE 0 END - CASE WHEN fn > 0.1 THEN 0.05 ELSE 0 END)), 6) AS DOUBLE) AS threshold FROM r")
def adjuster(spark, sf):
    r = det(spark, sf).groupBy("event_type").agg(F.avg((F.col("port") < 30).cast("double")).alias("fp"), F.avg((F.col("port") > 80).cast("double")).alias("fn"))
    t = F.lit(0.7) + F.when(F.col("fp") > 0.05, 0.05).otherwise(0.0) - F.when(F.col("fn") > 0.1, 0.05).otherwise(0.0)
    return r.select("event_type", F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.3), t)), 6).alias("threshold"))


@register("A48_audit_csv", f"WITH {D} SELECT event_id, concat_ws(',', event_id, src, event_type, severity, port) AS line FROM det")
def audit_csv(spark, sf):
    return det(spark, sf).select("event_id", F.concat_ws(",", "event_id", "src", "event_type", "severity", "port").alias("line"))


@register("A50_audit_ecs", f"""WITH {D} SELECT event_id, '{{"event":{{"kind":"' || event_type || '","severity":' || severity || '}},"source":{{"ip":"' || {IP} || '"}}}}' AS line FROM det""")
def audit_ecs(spark, sf):
    return det(spark, sf).select("event_id", F.to_json(F.struct(F.struct(F.col("event_type").alias("kind"), "severity").alias("event"), F.struct("ip").alias("source"))).alias("line"))


@register("A31_geoip", f"WITH {P} SELECT packet_id, CASE WHEN src_num >= 3232235520 THEN (src_num - 3232235520) // 8 ELSE (src_num - 167772160) // 8 + 1000 END AS block FROM pkt")
def geoip(spark, sf):
    """A range table as /29 blocks, one for every eight users however many there are, joined by prefix."""
    users = T.table(spark, sf, "events").select(F.floor(F.col("user_id") / 8).alias("id")).dropna().distinct()
    client = users.select(F.lit(29).alias("prefix"), (F.col("id") * 8 + T.CLIENT_BASE).alias("lo"), F.col("id").alias("block"))
    server = spark.range(16).select(F.lit(29).alias("prefix"), (F.col("id") * 8 + T.SERVER_BASE).alias("lo"), (F.col("id") + 1000).alias("block"))
    return L.cidr_join(T.packets(spark, sf).select("packet_id", "src_num"), "src_num", client.unionByName(server)).select("packet_id", "block")
