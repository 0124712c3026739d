"""Queries that parse rules and match them with texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plugins as G
from ..operators import rules as R
from ..sources import tables as T
from .registry import register

#: The rules that these queries match, in the usual one-line syntax.
RULES = [
    'alert tcp any any -> any 80 (msg:"english function words"; content:"that "; nocase; content:"with"; sid:1; rev:1; classtype:web-attack; priority:2;)',
    'alert tcp any any -> any [80,443] (msg:"card numbers"; content:"4"; content:!"the "; depth:200; sid:2; rev:3; classtype:policy-violation; threshold:type limit, track by_src, count 5, seconds 60;)',
    'drop tcp $HOME any -> any 8000:9000 (msg:"mail address"; content:"@mail"; fast_pattern; content:"example"; sid:3; rev:1; classtype:data-loss; priority:1;)',
    'alert udp any any <> any !53 (msg:"insults"; content:"|69 64 69 6f 74|"; offset:5; sid:4; rev:1; classtype:toxic; noalert;)',
    "# a comment",
    'alert http any any -> any any (msg:"short"; content:"AK"; sid:5; rev:1; classtype:credential;)',
]
PAYLOAD = {
    1: "contains(lower(text), 'that ') AND contains(text, 'with')",
    2: "contains(text, '4') AND NOT contains(substr(text, 1, 200), 'the ')",
    3: "contains(text, '@mail') AND contains(text, 'example')",
    4: "contains(substr(text, 6), 'idiot')",
    5: "contains(text, 'AK')",
}
HITS = " UNION ALL ".join(f"SELECT doc_id, {k} AS sid FROM documents WHERE {v}" for k, v in PAYLOAD.items())


def rules(spark):
    return R.parse_rules(spark.createDataFrame([(r,) for r in RULES], "value string"), variables={"HOME": "192.168.0.0/16"})


def hits(spark, sf):
    return R.match_rules(T.table(spark, sf, "documents").select("doc_id", "text"), rules(spark), "doc_id", "text")


@register("A18_inline_rules", "SELECT * FROM (VALUES (1, 'alert', 'tcp', 'any', '80', 2, 2, 'web-attack'), (2, 'alert', 'tcp', 'any', '[80,443]', 3, 2, 'policy-violation'), (3, 'drop', 'tcp', '192.168.0.0/16', '8000:9000', 1, 2, 'data-loss'), (4, 'alert', 'udp', 'any', '!53', 3, 1, 'toxic'), (5, 'alert', 'http', 'any', 'any', 3, 1, 'credential')) t(sid, action, proto, src, dst_port, priority, n_contents, classtype)")
def inline_rules(spark, sf):
    return rules(spark).select("sid", "action", "proto", "src", "dst_port", "priority", F.size("contents").alias("n_contents"), "classtype")


@register("C10_rule_join", f"SELECT * FROM ({HITS})")
def rule_join(spark, sf):
    return hits(spark, sf)


@register("C11_prefilter", "SELECT doc_id, contains(lower(text), 'that ') OR contains(lower(text), '@mail') OR contains(lower(text), 'idiot') AS candidate FROM documents")
def prefilter(spark, sf):
    # a handful of patterns: plain searches in generated code beat an automaton
    known = [r["p"] for r in rules(spark).select(R.fast_pattern(F.col("contents")).alias("p")).filter("p IS NOT NULL").collect()]
    t = F.lower("text")
    return T.table(spark, sf, "documents").select("doc_id", F.exists(F.array(*[F.lit(p) for p in known]), lambda p: F.contains(t, p)).alias("candidate"))


@register("D27_rule_stats", "SELECT 'alert' AS action, 'tcp' AS proto, CAST(2 AS BIGINT) AS n, CAST(1 AS BIGINT) AS limited UNION ALL SELECT 'drop', 'tcp', 1, 0 UNION ALL SELECT 'alert', 'udp', 1, 0 UNION ALL SELECT 'alert', 'http', 1, 0")
def rule_stats(spark, sf):
    return rules(spark).groupBy("action", "proto").agg(F.count(F.lit(1)).alias("n"), F.count("threshold").alias("limited"))


@register("B24_rule_inclusion", f"SELECT doc_id, sid FROM ({HITS}) WHERE sid NOT IN (2, 4)")
def rule_inclusion(spark, sf):
    kept = rules(spark).filter(~F.lower("classtype").isin("policy-violation", "toxic"))
    return R.match_rules(T.table(spark, sf, "documents").select("doc_id", "text"), kept, "doc_id", "text")


@register("B14_rule_verdict", f"SELECT doc_id, max(CASE sid WHEN 3 THEN 1 ELSE 0 END) = 1 AS dropped, count(*) AS hits FROM ({HITS}) WHERE sid <> 4 GROUP BY 1")
def rule_verdict(spark, sf):
    r = rules(spark).filter("NOT noalert").select("sid", (F.col("action") == "drop").alias("drop"))
    return hits(spark, sf).join(r, "sid").groupBy("doc_id").agg(F.bool_or("drop").alias("dropped"), F.count(F.lit(1)).alias("hits"))


@register("B52_rules_by_keyword", f"SELECT sid, count(*) AS n FROM ({HITS}) GROUP BY 1")
def rules_by_keyword(spark, sf):
    return hits(spark, sf).groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


@register("B11_rule_headers", f"WITH {T.PACKETS} SELECT packet_id, sid FROM pkt JOIN (VALUES (1, 6), (2, 6), (3, 6), (4, 17)) r(sid, p) ON proto = p WHERE CASE sid WHEN 1 THEN dst_port = 80 WHEN 2 THEN dst_port IN (80, 443) WHEN 3 THEN dst_port BETWEEN 8000 AND 9000 AND src_num BETWEEN 3232235520 AND 3232301055 ELSE dst_port <> 53 END")
def rule_headers(spark, sf):
    from ..operators import lookups as L

    r = rules(spark).select("sid", "dst_port", "src", F.when(F.col("proto") == "tcp", 6).when(F.col("proto") == "udp", 17).alias("proto")).withColumnRenamed("dst_port", "spec")
    headers = L.cidr_bounds(r.withColumn("net", F.when(F.col("src") == "any", "0.0.0.0/0").otherwise(F.col("src"))), "net").filter("proto IS NOT NULL")
    return R.header_join(T.packets(spark, sf), headers, "src_num", "dst_port").select("packet_id", "sid")


@register("J03_plugins", f"WITH {T.DETECTIONS} SELECT event_id, 'burst' AS detector, 3 AS severity, least(1.0, value / 250) AS confidence, 'block' AS action FROM det WHERE event_type = 'error' AND value > 100 UNION ALL SELECT event_id, 'low_port', 1, 0.5, 'log' FROM det WHERE port < 20")
def run_plugins(spark, sf):
    reg = G.Registry()
    reg.add("burst", lambda df: G.result("burst", (F.col("event_type") == "error") & (F.col("value") > 100), F.col("value") / 250, 3, "block"))
    reg.add("low_port", lambda df: G.result("low_port", F.col("port") < 20, F.lit(0.5), 1, "log"))
    return G.to_detections(reg.evaluate(T.detections(spark, sf)), "event_id")


SIZES = ["5", ">30", "<12", "10<>20", ">=45", "<=3", "none"]


@register("H19_size_spec", "WITH s(i, low, high) AS (VALUES (0, 5, 5), (1, 31, 4611686018427387904), (2, 0, 11), (3, 11, 19), (4, 45, 4611686018427387904), (5, 0, 3)) SELECT p_partkey, p_size BETWEEN low AND high AS fits FROM part LEFT JOIN s ON p_partkey % 7 = i")
def size_specs(spark, sf):
    spec = F.element_at(F.array(*[F.lit(x) for x in SIZES]), (F.col("p_partkey") % 7 + 1).cast("int"))
    m = R.size_spec(spec)
    return T.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").between(m["low"], m["high"]).alias("fits"))


@register("H24_literal_patterns", "SELECT page_id, contains(url, substr(url, 10, 4)) AS own, contains(lower(url), 'com/p') AS low FROM pages")
def literal_patterns(spark, sf):
    """Contents with dots and question marks in them match as they stand; `own` takes each row's own pattern."""
    own = R.literal_pattern(F.substring("url", 10, 4), F.lit(False))
    return T.table(spark, sf, "pages").select("page_id", F.call_function("rlike", F.col("url"), own).alias("own"), F.call_function("rlike", F.col("url"), R.literal_pattern(F.lit("COM/P"), F.lit(True))).alias("low"))
