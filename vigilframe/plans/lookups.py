"""Queries that look rows up: indicators, networks, zones, domains, versions, nearest in time, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lookups as L
from ..sources import tables as T
from .registry import register

D, P = T.DETECTIONS, T.PACKETS
#: A derived network list: every supplier announces 192.168.(key mod 4).(16 * (key mod 16))/28, every nation 192.168.(key mod 4).0/24, every region 192.168.0.0/16.
NETS = """nets AS (
  SELECT 28 AS prefix, 3232235520 + (s_suppkey % 4) * 256 + (s_suppkey // 4 % 16) * 16 AS lo, min(s_suppkey) AS net_id FROM supplier GROUP BY 1, 2
  UNION ALL SELECT 24, 3232235520 + (n_nationkey % 4) * 256, min(n_nationkey) FROM nation GROUP BY 1, 2
  UNION ALL SELECT 16, 3232235520, min(r_regionkey) FROM region GROUP BY 1, 2)"""


def nets(spark, sf):
    s, n, r = (T.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    base = F.lit(T.CLIENT_BASE).cast("long")
    a = s.groupBy(F.lit(28).alias("prefix"), (base + F.col("s_suppkey") % 4 * 256 + F.floor(F.col("s_suppkey") / 4) % 16 * 16).alias("lo")).agg(F.min("s_suppkey").cast("long").alias("net_id"))
    b = n.groupBy(F.lit(24).alias("prefix"), (base + F.col("n_nationkey") % 4 * 256).alias("lo")).agg(F.min("n_nationkey").cast("long").alias("net_id"))
    c = r.groupBy(F.lit(16).alias("prefix"), base.alias("lo")).agg(F.min("r_regionkey").cast("long").alias("net_id"))
    return a.unionByName(b).unionByName(c)


BEST = f"""hit AS (SELECT packet_id, src_num, prefix, net_id, row_number() OVER (PARTITION BY packet_id ORDER BY prefix DESC) AS rn FROM pkt JOIN nets ON src_num BETWEEN lo AND lo + (1::BIGINT << (32 - prefix)) - 1)"""


@register("C08_cidr_join", f"WITH {P}, {NETS}, {BEST} SELECT packet_id, prefix, net_id FROM hit WHERE rn = 1")
def cidr_join(spark, sf):
    return L.cidr_join(T.packets(spark, sf).select("packet_id", "src_num"), "src_num", nets(spark, sf), "inner").select("packet_id", "prefix", "net_id")


@register("C09_zone_join", f"WITH {P}, {NETS}, {BEST} SELECT pkt.packet_id, CASE hit.prefix WHEN 28 THEN 'trusted' WHEN 24 THEN 'office' WHEN 16 THEN 'site' ELSE 'outside' END AS zone FROM pkt LEFT JOIN hit ON pkt.packet_id = hit.packet_id AND rn = 1")
def zone_join(spark, sf):
    z = L.cidr_join(T.packets(spark, sf).select("packet_id", "src_num"), "src_num", nets(spark, sf))
    return z.select("packet_id", F.when(F.col("prefix") == 28, "trusted").when(F.col("prefix") == 24, "office").when(F.col("prefix") == 16, "site").otherwise("outside").alias("zone"))


@register("B07_ip_status", f"""WITH {P}, {NETS}, {BEST}, ex AS (SELECT s_suppkey + 3232235520 AS num, s_acctbal FROM supplier WHERE s_acctbal > 0)
 SELECT pkt.packet_id, CASE WHEN ex.num IS NOT NULL THEN 'exact' WHEN hit.prefix >= 24 THEN 'network' ELSE 'default' END AS status FROM pkt LEFT JOIN ex ON pkt.src_num = ex.num LEFT JOIN hit ON pkt.packet_id = hit.packet_id AND rn = 1""")
def ip_status(spark, sf):
    ex = T.table(spark, sf, "supplier").filter("s_acctbal > 0").select((F.col("s_suppkey") + T.CLIENT_BASE).alias("src_num"), F.lit(True).alias("exact"))
    p = T.packets(spark, sf).select("packet_id", "src_num").join(ex, "src_num", "left")
    out = L.cidr_join(p, "src_num", nets(spark, sf))
    return out.select("packet_id", F.when(F.col("exact"), "exact").when(F.col("prefix") >= 24, "network").otherwise("default").alias("status"))


@register("B33_zone_trust", f"WITH {P}, {NETS}, {BEST} SELECT packet_id, prefix >= 24 AS trusted FROM hit WHERE rn = 1")
def zone_trust(spark, sf):
    z = L.cidr_join(T.packets(spark, sf).select("packet_id", "src_num"), "src_num", nets(spark, sf), "inner")
    return z.select("packet_id", (F.col("prefix") >= 24).alias("trusted"))


@register("B35_proxy_predicate", f"WITH {P}, {NETS}, {BEST} SELECT pkt.src_num, count(*) AS n FROM pkt WHERE packet_id NOT IN (SELECT packet_id FROM hit WHERE prefix = 28) GROUP BY 1")
def proxy_predicate(spark, sf):
    z = L.cidr_join(T.packets(spark, sf).select("packet_id", "src_num"), "src_num", nets(spark, sf).filter("prefix = 28"))
    return z.filter("prefix IS NULL").groupBy("src_num").agg(F.count(F.lit(1)).alias("n"))


@register("B37_bogon", f"WITH {P} SELECT packet_id, CASE WHEN dst_num BETWEEN 167772160 AND 184549375 THEN 'private_10' WHEN dst_num BETWEEN 3232235520 AND 3232301055 THEN 'private_192' ELSE 'routable' END AS kind FROM pkt")
def bogon(spark, sf):
    table = spark.createDataFrame([("10.0.0.0/8", "private_10"), ("192.168.0.0/16", "private_192"), ("127.0.0.0/8", "loopback"), ("224.0.0.0/4", "multicast")], "cidr string, kind string")
    known = L.cidr_bounds(table, "cidr").select("prefix", "lo", "kind")
    out = L.cidr_join(T.packets(spark, sf).select("packet_id", "dst_num"), "dst_num", known)
    return out.select("packet_id", F.coalesce("kind", F.lit("routable")).alias("kind"))


@register("B09_rule_ip", f"WITH {P} SELECT packet_id FROM pkt WHERE (src_num = 3232235525 OR src_num BETWEEN 3232235530 AND 3232235540) AND NOT dst_num BETWEEN 167772160 AND 167772161")
def rule_ip(spark, sf):
    s, d = F.col("src_num"), F.col("dst_num")
    num = lambda x: L.ip_to_long(F.lit(x))
    return T.packets(spark, sf).filter(((s == num("192.168.0.5")) | s.between(num("192.168.0.10"), num("192.168.0.20"))) & ~d.between(num("10.0.0.0"), num("10.0.0.1"))).select("packet_id")


@register("C05_ioc_exact_ip", f"WITH {P}, ioc AS (SELECT s_suppkey + 3232235520 AS num, s_name AS source, CASE WHEN s_acctbal < 5000 THEN 1 ELSE 3 END AS severity FROM supplier WHERE s_acctbal >= 0) SELECT packet_id, source, severity FROM pkt JOIN ioc ON src_num = num")
def ioc_exact_ip(spark, sf):
    ioc = T.table(spark, sf, "supplier").filter("s_acctbal >= 0").select((F.col("s_suppkey") + T.CLIENT_BASE).alias("src_num"), F.col("s_name").alias("source"), F.when(F.col("s_acctbal") < 5000, 1).otherwise(3).alias("severity"))
    return T.packets(spark, sf).join(ioc, "src_num").select("packet_id", "source", "severity")


HOST = "regexp_extract(url, '^https?://([^/:?]+)', 1)"


def hosts(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("url", r"^https?://([^/:?]+)", 1).alias("host"))


@register("C06_domain_suffix", f"""WITH h AS (SELECT page_id, lower({HOST}) AS host FROM pages), dom AS (SELECT DISTINCT host AS d FROM h WHERE page_id % 3 = 0 UNION SELECT 'example.com')
 SELECT page_id, max_by(d, length(d)) AS matched FROM h JOIN dom ON host = d OR ends_with(host, '.' || d) GROUP BY 1""")
def domain_suffix(spark, sf):
    h = hosts(spark, sf)
    listed = h.filter("page_id % 3 = 0").select(F.lower("host").alias("domain")).union(spark.createDataFrame([("example.com",)], "domain string")).distinct()
    return L.suffix_join(h, "host", listed, "domain", "page_id").filter("matched IS NOT NULL").select("page_id", "matched")


@register("C07_ioc_url_hash", "SELECT a.page_id, md5(a.url) AS url_hash FROM pages a JOIN (SELECT DISTINCT md5(url) AS h FROM pages WHERE page_id % 5 = 0) b ON md5(a.url) = b.h")
def ioc_url_hash(spark, sf):
    p = T.table(spark, sf, "pages").select("page_id", F.md5(F.col("url").cast("binary")).alias("url_hash"))
    bad = p.filter("page_id % 5 = 0").select("url_hash").distinct()
    return p.join(bad, "url_hash", "left_semi").select("page_id", "url_hash")


@register("C14_nearest_detection", f"""WITH {D}, l AS (SELECT * FROM det WHERE event_type = 'error'), d AS (SELECT * FROM det WHERE event_type <> 'error'),
 j AS (SELECT l.event_id, d.event_id AS det_id, abs(epoch_us(d.ts) - epoch_us(l.ts)) AS dist, epoch_us(d.ts) AS dus FROM l JOIN d ON l.src = d.src AND abs(epoch_us(d.ts) - epoch_us(l.ts)) <= 21600000000),
 b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, dus, det_id) AS rn FROM j) SELECT l.event_id, b.det_id, b.dist FROM l LEFT JOIN b ON l.event_id = b.event_id AND rn = 1""")
def nearest_detection(spark, sf):
    d = T.detections(spark, sf).withColumn("us", F.unix_micros("ts"))
    logs, found = d.filter("event_type = 'error'").select("event_id", "src", "us"), d.filter("event_type <> 'error'").select(F.col("event_id").alias("det_id"), "src", "us")
    return L.nearest_join(logs, found, ["src"], "event_id", "det_id", 21_600_000_000).select("event_id", "det_id", "dist")


@register("C15_unlogged_detections", f"WITH {D} SELECT d.event_id FROM det d WHERE d.event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM det l WHERE l.event_type = 'error' AND l.src = d.src AND abs(epoch_us(d.ts) - epoch_us(l.ts)) <= 21600000000)")
def unlogged_detections(spark, sf):
    d = T.detections(spark, sf).withColumn("us", F.unix_micros("ts"))
    logs, found = d.filter("event_type = 'error'").select(F.col("event_id").alias("log_id"), "src", "us"), d.filter("event_type <> 'error'").select("event_id", "src", "us")
    return L.nearest_join(found, logs, ["src"], "event_id", "log_id", 21_600_000_000).filter("log_id IS NULL").select("event_id")


@register("C16_classification", f"""WITH {D} SELECT l.event_id, CASE WHEN l.severity >= 2 THEN CASE WHEN m THEN 'TP' ELSE 'FN' END ELSE CASE WHEN m THEN 'FP' ELSE 'TN' END END AS outcome FROM (SELECT a.event_id, a.severity, EXISTS (SELECT 1 FROM det b WHERE b.src = a.src AND b.event_type = 'click' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 10800000000) AS m FROM det a) l""")
def classification(spark, sf):
    d = T.detections(spark, sf).withColumn("us", F.unix_micros("ts"))
    alerts = d.filter("event_type = 'click'").select(F.col("event_id").alias("alert_id"), "src", "us")
    m = L.nearest_join(d.select("event_id", "src", "severity", "us"), alerts, ["src"], "event_id", "alert_id", 10_800_000_000)
    attack, hit = F.col("severity") >= 2, F.col("alert_id").isNotNull()
    return m.select("event_id", F.when(attack, F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit, "FP").otherwise("TN")).alias("outcome"))


@register("C12_event_incident", f"""WITH {D}, i AS (SELECT src, event_id AS incident_id, ts FROM det WHERE severity = 3)
 SELECT e.event_id, max(i.incident_id) AS incident_id FROM det e ASOF LEFT JOIN i ON e.src = i.src AND e.ts >= i.ts GROUP BY 1""")
def event_incident(spark, sf):
    d = T.detections(spark, sf)
    w = Window.partitionBy("src").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("event_id", F.last(F.when(F.col("severity") == 3, F.col("event_id")), ignorenulls=True).over(w).alias("incident_id"))


@register("C17_ground_truth", f"""WITH {D}, g AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 3 = 0)
 SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'FP' WHEN c_acctbal >= 0 AND (event_type = 'error' OR c_mktsegment = 'BUILDING') THEN 'TP' ELSE 'TP_generic' END AS outcome FROM det LEFT JOIN g ON user_id = c_custkey""")
def ground_truth(spark, sf):
    g = T.table(spark, sf, "customer").filter("c_custkey % 3 = 0").select("c_custkey", "c_mktsegment", "c_acctbal")
    d = T.detections(spark, sf)
    exact = (F.col("c_acctbal") >= 0) & ((F.col("event_type") == "error") | (F.col("c_mktsegment") == "BUILDING"))
    return d.join(g, d["user_id"] == g["c_custkey"], "left").select("event_id", F.when(F.col("c_custkey").isNull(), "FP").when(exact, "TP").otherwise("TP_generic").alias("outcome"))


@register("C18_truth_window", f"WITH {D} SELECT event_id, o_orderkey FROM det JOIN orders ON user_id = o_custkey AND o_orderkey % 10 = port % 10 AND severity >= 2")
def truth_window(spark, sf):
    d, o = T.detections(spark, sf).filter("severity >= 2"), T.table(spark, sf, "orders")
    return d.join(o, (d["user_id"] == o["o_custkey"]) & (o["o_orderkey"] % 10 == d["port"] % 10)).select("event_id", "o_orderkey")


#: A small vulnerability list (software, first affected, first fixed, severity).
CVES = [("small ring", "1.0.0", "3.5.0", 9.8), ("red widget", "2.1.0", "2.9.9", 5.3), ("big bolt", "0.1.0", "9.0.0", 7.5)]
VER = "CAST(p_size % 10 AS VARCHAR) || '.' || CAST(p_partkey % 7 AS VARCHAR) || '.' || CAST(p_partkey % 3 AS VARCHAR)"


@register("C20_cve_join", f"""WITH v AS (SELECT p_partkey, p_name, p_size % 10 AS a, p_partkey % 7 AS b, p_partkey % 3 AS c FROM part),
 cve(name, a1, b1, c1, a2, b2, c2, sev) AS (VALUES ('small ring', 1, 0, 0, 3, 5, 0, 9.8), ('red widget', 2, 1, 0, 2, 9, 9, 5.3), ('big bolt', 0, 1, 0, 9, 0, 0, 7.5))
 SELECT p_partkey, CAST(max(sev) AS DOUBLE) AS worst FROM v JOIN cve ON p_name = name AND (a, b, c) >= (a1, b1, c1) AND (a, b, c) < (a2, b2, c2) GROUP BY 1""")
def cve_join(spark, sf):
    p = T.table(spark, sf, "part")
    version = F.concat_ws(".", (F.col("p_size") % 10).cast("string"), (F.col("p_partkey") % 7).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    have = p.select("p_partkey", "p_name", L.version_parts(version).alias("v"))
    cve = spark.createDataFrame(CVES, "p_name string, first string, fixed string, sev double").select("p_name", L.version_parts(F.col("first")).alias("first"), L.version_parts(F.col("fixed")).alias("fixed"), "sev")
    hit = have.join(cve, "p_name").filter((F.col("v") >= F.col("first")) & (F.col("v") < F.col("fixed")))
    return hit.groupBy("p_partkey").agg(F.max("sev").alias("worst"))


@register("C21_hassh_lookup", "SELECT page_id, md5(split_part(url, '/', 4)) AS hassh, split_part(url, '/', 4) IN ('fr', 'de') AS known FROM pages")
def hassh_lookup(spark, sf):
    p = T.table(spark, sf, "pages").select("page_id", F.md5(F.split_part("url", F.lit("/"), F.lit(4)).cast("binary")).alias("hassh"))
    db = spark.createDataFrame([("fr",), ("de",)], "x string").select(F.md5(F.col("x").cast("binary")).alias("hassh"), F.lit(True).alias("known"))
    return p.join(db, "hassh", "left").select("page_id", "hassh", F.coalesce("known", F.lit(False)).alias("known"))


@register("C22_vector_signatures", """WITH s AS (SELECT vec_id AS sig_id, label AS sig_label, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), j AS (SELECT vec_id, sig_id, sig_label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS c FROM embeddings, s WHERE vec_id <> sig_id),
 b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, sig_id) AS rn FROM j) SELECT vec_id, sig_id, sig_label, round(c, 6) AS score FROM b WHERE rn = 1 AND c >= 0.5""")
def vector_signatures(spark, sf):
    e = T.table(spark, sf, "embeddings")
    sig = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("sig_id"), F.col("label").alias("sig_label"), "embedding")
    best = L.nearest(e, sig, 1, "vec_id", "sig_id", "embedding", carry=("sig_label",))
    return best.filter("score >= 0.5").select("vec_id", "sig_id", "sig_label", F.round("score", 6).alias("score"))


@register("F07_knn", """WITH q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), j AS (SELECT q_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS c FROM embeddings, q WHERE vec_id <> q_id),
 b AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY c DESC, vec_id) AS rn FROM j) SELECT q_id, vec_id, CAST(rn AS INTEGER) AS rank, round(c, 6) AS score FROM b WHERE rn <= 10""")
def knn(spark, sf):
    e = T.table(spark, sf, "embeddings")
    out = L.knn(e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "q_id"), e, 10, "q_id", "vec_id", "embedding")
    return out.select("q_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@register("C24_rag_search", """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) >= 0.1 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) DESC, vec_id LIMIT 20""")
def rag_search(spark, sf):
    e = T.table(spark, sf, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    s = e.join(F.broadcast(q)).select("vec_id", L.cosine(F.col("embedding"), F.col("q")).alias("s"))  # one query row
    return s.filter("s >= 0.1").orderBy(F.desc("s"), F.asc("vec_id")).limit(20).select("vec_id", F.round("s", 6).alias("score"))


@register("C25_rag_filtered", """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE label IN (1, 2)""")
def rag_filtered(spark, sf):
    e = T.table(spark, sf, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.filter("label IN (1, 2)").join(F.broadcast(q)).select("vec_id", "label", F.round(L.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


def rag_all(spark, sf, sources=None):
    e = T.table(spark, sf, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), "embedding")
    hit = L.nearest(q, e if sources is None else e.filter(F.col("label").isin(*sources)), 20, "q_id", "vec_id", "embedding", carry=("label",), own=True)
    return hit.filter("score >= 0.1").withColumn("score", F.round("score", 6))


@register("C24_rag_search_all", """WITH q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), j AS (SELECT q_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS c FROM embeddings, q),
 b AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY c DESC, vec_id) AS rn FROM j) SELECT q_id, vec_id, CAST(rn AS INTEGER) AS rank, round(c, 6) AS score FROM b WHERE rn <= 20 AND c >= 0.1""")
def rag_search_all(spark, sf):
    return rag_all(spark, sf).select("q_id", "vec_id", "rank", "score")


@register("C25_rag_filtered_all", """WITH q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), j AS (SELECT q_id, vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS c FROM embeddings, q WHERE label IN (1, 2)),
 b AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY c DESC, vec_id) AS rn FROM j) SELECT q_id, vec_id, label, CAST(rn AS INTEGER) AS rank, round(c, 6) AS score FROM b WHERE rn <= 20 AND c >= 0.1""")
def rag_filtered_all(spark, sf):
    return rag_all(spark, sf, (1, 2)).select("q_id", "vec_id", "label", "rank", "score")


@register("C23_baseline_anomaly", """WITH b AS (SELECT label, list(embedding ORDER BY vec_id)[1] AS q FROM embeddings GROUP BY 1), j AS (SELECT vec_id, 1 - max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))) AS d FROM embeddings, b GROUP BY 1) SELECT vec_id, round(d, 6) AS distance, d > 0.7 AS anomaly FROM j""")
def baseline_anomaly(spark, sf):
    e = T.table(spark, sf, "embeddings")
    base = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q")).agg(F.collect_list("q").alias("qs"))  # one vector per label
    d = e.join(F.broadcast(base)).select("vec_id", (1 - F.array_max(F.transform("qs", lambda q: L.cosine(F.col("embedding"), q)))).alias("d"))
    return d.select("vec_id", F.round("d", 6).alias("distance"), (F.col("d") > 0.7).alias("anomaly"))


@register("C26_hassh_similarity", """WITH s AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS algs FROM orders GROUP BY 1), r AS (SELECT ['1-URGENT', '2-HIGH', '3-MEDIUM'] AS ref) SELECT o_custkey, round(len(list_intersect(algs, ref)) / len(list_distinct(list_concat(algs, ref))), 6) AS similarity FROM s, r WHERE len(list_intersect(algs, ref)) / len(list_distinct(list_concat(algs, ref))) >= 0.5""")
def hassh_similarity(spark, sf):
    s = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("algs"))
    ref = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")])
    return s.select("o_custkey", F.round(L.jaccard(F.col("algs"), ref), 6).alias("similarity")).filter("similarity >= 0.5")


@register("H57_cosine", "SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS c, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf):
    e = T.table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    a, b = F.col("embedding"), F.col("e2")
    return e.join(n, "vec_id").select("vec_id", F.round(L.cosine(a, b), 6).alias("c"), F.round(L.euclidean(a, b), 6).alias("d"))


@register("H38_semver", f"SELECT p_partkey, {VER} AS version, (p_size % 10, p_partkey % 7, p_partkey % 3) >= (3, 2, 1) AS newer FROM part")
def semver(spark, sf):
    v = F.concat_ws(".", (F.col("p_size") % 10).cast("string"), (F.col("p_partkey") % 7).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    return T.table(spark, sf, "part").select("p_partkey", v.alias("version"), (L.version_parts(v) >= L.version_parts(F.lit("3.2.1"))).alias("newer"))


@register("H63_internal_ip", f"WITH {P} SELECT packet_id, src_num BETWEEN 167772160 AND 184549375 OR src_num BETWEEN 3232235520 AND 3232301055 AS internal FROM pkt")
def internal_ip(spark, sf):
    s = F.col("src_num")
    num = lambda x: L.ip_to_long(F.lit(x))
    return T.packets(spark, sf).select("packet_id", (s.between(num("10.0.0.0"), num("10.255.255.255")) | s.between(num("192.168.0.0"), num("192.168.255.255"))).alias("internal"))


@register("F10_cidr_specificity", f"WITH {NETS} SELECT prefix, lo, net_id FROM nets ORDER BY prefix DESC, lo LIMIT 25")
def cidr_specificity(spark, sf):
    return nets(spark, sf).orderBy(F.desc("prefix"), F.asc("lo")).limit(25)


@register("D50_bogon_features", f"WITH {P} SELECT src_num, round(avg(CASE WHEN dst_num BETWEEN 167772160 AND 184549375 THEN 1.0 ELSE 0.0 END), 6) AS bogon, round(avg(CASE WHEN src_num = dst_num THEN 1.0 ELSE 0.0 END), 6) AS land FROM pkt GROUP BY 1")
def bogon_features(spark, sf):
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return T.packets(spark, sf).groupBy("src_num").agg(share(F.col("dst_num").between(167772160, 184549375)).alias("bogon"), share(F.col("src_num") == F.col("dst_num")).alias("land"))
