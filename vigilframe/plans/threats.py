"""Queries over the default correlation rules, kill chains, TCP states, and protocol, severity and label rules.

The operators have the default limits; only the mapping from the given tables to their input columns is made up here.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as C
from ..operators import flows as X
from ..operators import protocol_rules as PR
from ..sources import tables as T
from .registry import register

D, P = T.DETECTIONS, T.PACKETS
TYPES = sorted({t for r in C.COUNT_RULES for t in r[1]} | {t for r in C.SEQUENCE_RULES for t in r[1:3]})
#: An event's second in a day that stands for a month, so that the rules' windows hold events.
SPAN = 720


def listed(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def typed(spark, sf):
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("event_id") % len(TYPES) + 1).cast("int"))
    return T.detections(spark, sf).select("event_id", F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("src"), F.concat(F.lit("d"), (F.col("port") % 3).cast("string")).alias("dst"), kind.alias("type"), F.floor(F.unix_micros("ts") / SPAN).cast("long").alias("us"))


TYPED = f"{D}, ty AS (SELECT event_id, 's' || user_id % 4 AS src, 'd' || port % 3 AS dst, list_extract({listed(TYPES)}, CAST(event_id % {len(TYPES)} + 1 AS INTEGER)) AS type, epoch_us(ts) // {SPAN} AS us FROM det)"
COUNTED = ", ".join(f"('{n}', '{t}', {k}, {w}, '{by}', {str(up).lower()})" for n, types, k, w, by, up in C.COUNT_RULES for t in types)
STAGED = ", ".join(f"('{n}', '{a}', '{b}', {gap})" for n, a, b, gap in C.SEQUENCE_RULES)


@register("I17_default_rules", f"WITH {TYPED}, r(rule, type, least, secs, per, elevate) AS (VALUES {COUNTED}), e AS (SELECT *, CASE per WHEN 'dst' THEN dst ELSE src END AS key, us * (600 // secs) AS tt FROM ty JOIN r USING (type)), c AS (SELECT event_id, rule, least, elevate, count(*) OVER (PARTITION BY rule, key ORDER BY tt RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS n FROM e) SELECT event_id, rule, n, elevate FROM c WHERE n >= least")
def default_rules(spark, sf):
    return C.count_matches(typed(spark, sf))


@register("E07_default_sequences", f"WITH {TYPED}, r(rule, a, b, gap) AS (VALUES {STAGED}), f AS (SELECT rule, src, min(us) AS first_us FROM ty JOIN r ON type = a GROUP BY 1, 2) SELECT f.rule, f.src, first_us, min(us) AS second_us FROM f JOIN r USING (rule) JOIN ty ON ty.type = r.b AND ty.src = f.src AND us > first_us AND us - first_us < gap * 1000000::BIGINT GROUP BY 1, 2, 3")
def default_sequences(spark, sf):
    return C.sequence_matches(typed(spark, sf))


def chain_sql():
    rows = ", ".join(f"({i}, '{n}', {listed(need)}, {listed([*need, *may])}, {least})" for i, (n, need, may, least) in enumerate(C.CHAINS))
    return f"""WITH {D}, s AS (SELECT user_id, list(DISTINCT list_extract({listed(C.TACTICS)}, CAST(event_id % 14 + 1 AS INTEGER))) AS seen FROM det WHERE severity >= 1 GROUP BY 1),
 p(o, name, need, every_, least) AS (VALUES {rows}), m AS (SELECT user_id, o, name, len(list_intersect(seen, need)) AS hits, len(need) AS n, least, list_max(list_transform(list_intersect(seen, every_), lambda t: list_position({listed(C.TACTICS)}, t))) AS last FROM s, p),
 b AS (SELECT *, least(1.0::DOUBLE, hits / n * 0.7::DOUBLE + 0.3::DOUBLE) AS conf FROM m WHERE hits >= least), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY conf DESC, o) AS rn FROM b)
 SELECT user_id, name, round(conf, 6) AS confidence, round(last / 14, 6) AS progression FROM k WHERE rn = 1"""


@register("D26_default_chains", chain_sql())
def default_chains(spark, sf):
    tactic = F.element_at(F.array(*[F.lit(t) for t in C.TACTICS]), (F.col("event_id") % 14 + 1).cast("int"))
    seen = T.detections(spark, sf).filter("severity >= 1").groupBy("user_id").agg(F.collect_set(tactic).alias("seen"))  # 14 tactics at most
    m = seen.withColumn("m", C.chain_match(F.col("seen"))).filter("m IS NOT NULL")
    return m.select("user_id", "m.name", F.round("m.confidence", 6).alias("confidence"), F.round("m.progression", 6).alias("progression"))


@register("I19_incident_hosts", f"WITH {D}, i AS (SELECT user_id AS incident, 's' || user_id % 4 AS a, 'd' || min(port) % 3 AS b FROM det GROUP BY 1) SELECT a AS host, incident FROM i UNION SELECT b, incident FROM i")
def incident_hosts(spark, sf):
    i = T.detections(spark, sf).groupBy(F.col("user_id").alias("incident")).agg(F.min("port").alias("p"))
    hosts = F.array(F.concat(F.lit("s"), (F.col("incident") % 4).cast("string")), F.concat(F.lit("d"), (F.col("p") % 3).cast("string")))
    return C.incident_hosts(i.select("incident", hosts.alias("created_hosts")))


SYN, ACK, RST, FIN = (f"(c // 2) & {b} <> 0" for b in (2, 16, 4, 1))
MOVES = f"""CASE s WHEN 1000 THEN CASE WHEN {SYN} AND NOT {ACK} THEN 1001 ELSE 1003 END
 WHEN 1001 THEN CASE WHEN {SYN} AND {ACK} AND c % 2 = 0 THEN 1002 WHEN {RST} THEN 1009 ELSE s END WHEN 1002 THEN CASE WHEN {ACK} AND c % 2 = 1 THEN 1003 WHEN {RST} THEN 1009 ELSE s END
 WHEN 1003 THEN CASE WHEN {RST} THEN 1009 WHEN {FIN} THEN 1004 ELSE s END WHEN 1004 THEN CASE WHEN {FIN} AND {ACK} THEN 1007 WHEN {FIN} THEN 1006 WHEN {ACK} THEN 1005 WHEN {RST} THEN 1009 ELSE s END
 WHEN 1005 THEN CASE WHEN {FIN} THEN 1007 WHEN {RST} THEN 1009 ELSE s END WHEN 1006 THEN CASE WHEN {ACK} THEN 1007 WHEN {RST} THEN 1009 ELSE s END WHEN 1007 THEN CASE WHEN {RST} THEN 1009 ELSE s END ELSE s END"""
FLOW = "least(src_num, dst_num), greatest(src_num, dst_num), cport, vport"


@register("E06_directed_states", f"""WITH {P}, t0 AS (SELECT p.*, least(src_num, dst_num) AS lo, greatest(src_num, dst_num) AS hi, least(src_port, dst_port) AS pa, greatest(src_port, dst_port) AS pb FROM pkt p WHERE proto = 6),
 t1 AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY lo, hi, pa, pb ORDER BY ts, packet_id) AS gap FROM t0),
 t AS (SELECT *, CAST(sum(CASE WHEN gap > 300 * 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY lo, hi, pa, pb ORDER BY ts, packet_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM t1),
 c AS (SELECT lo, hi, pa, pb, session, ts, packet_id, CAST(flags * 2 + CASE WHEN src_num = first_value(src_num) OVER (PARTITION BY lo, hi, pa, pb, session ORDER BY ts, packet_id) THEN 1 ELSE 0 END AS BIGINT) AS code FROM t),
 g AS (SELECT lo, hi, pa, pb, session, list_prepend(1000::BIGINT, list(code ORDER BY ts, packet_id)) AS l FROM c GROUP BY ALL)
 SELECT lo, hi, pa, pb, session, list_extract({listed(X.TCP_STATES)}, CAST(list_reduce(l, lambda s, c: {MOVES}) - 999 AS INTEGER)) AS state FROM g""")
def directed_states(spark, sf):
    p = T.packets(spark, sf).filter("proto = 6").withColumns({"lo": F.least("src_num", "dst_num"), "hi": F.greatest("src_num", "dst_num"), "pa": F.least("src_port", "dst_port"), "pb": F.greatest("src_port", "dst_port")})
    p = X.gap_sessions(p, ["lo", "hi", "pa", "pb"], ["ts", "packet_id"], X.flow_timeout_us(3600))
    return X.directed_tcp_state(p, ["lo", "hi", "pa", "pb", "session"])


KINDS = [k for kinds in PR.LOG_SEVERITY.values() for k in kinds] + ["Unknown"]
SCORES = "CASE k " + " ".join(f"WHEN '{k}' THEN {score}" for score, kinds in PR.LOG_SEVERITY.items() for k in kinds) + " ELSE 1 END"


@register("H07_log_severity", f"WITH t AS (SELECT event_id, list_extract({listed(KINDS)}, CAST(event_id % {len(KINDS)} + 1 AS INTEGER)) AS k FROM events) SELECT event_id, k AS kind, {SCORES} AS score FROM t")
def log_severity(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("event_id") % len(KINDS) + 1).cast("int"))
    return T.table(spark, sf, "events").select("event_id", kind.alias("kind")).withColumn("score", PR.log_severity(F.col("kind")))


@register("H84_priority_severity", f"WITH {D} SELECT event_id, CASE port % 5 WHEN 1 THEN 'Critical' WHEN 2 THEN 'High' WHEN 3 THEN 'Medium' ELSE 'Low' END AS severity FROM det")
def priority_severity(spark, sf):
    return T.detections(spark, sf).select("event_id", PR.priority_severity(F.col("port") % 5).alias("severity"))


@register("H86_elevated", f"WITH {D} SELECT event_id, list_extract({listed(PR.SEVERITIES)}, least(severity + port % 2 + 2, 5)) AS severity FROM det")
def elevated(spark, sf):
    name = F.element_at(F.array(*[F.lit(s) for s in PR.SEVERITIES]), F.col("severity") + F.col("port") % 2 + 1)
    return T.detections(spark, sf).select("event_id", PR.elevated(name).alias("severity"))


LABELS = ["DoS SYN_Flood", "udpflood", "icmp_flood x", "exhaustion", "SYN scan", "connect()", "FIN", "xmas tree", "NULL", "UDP sweep", "ssh-brute", "ping", "DNS amplification", "BENIGN"]
LABELLED = "CASE i WHEN 0 THEN 'SynFlood' WHEN 1 THEN 'UdpFlood' WHEN 2 THEN 'IcmpFlood' WHEN 3 THEN 'ConnectionExhaustion' WHEN 4 THEN 'PortScan:TcpSyn' WHEN 5 THEN 'PortScan:TcpConnect' WHEN 6 THEN 'PortScan:TcpFin' WHEN 7 THEN 'PortScan:TcpXmas' WHEN 8 THEN 'PortScan:TcpNull' WHEN 9 THEN 'PortScan:Udp' WHEN 10 THEN 'BruteForce' WHEN 11 THEN 'PingSweep' WHEN 12 THEN 'Amplification' END"


@register("H14_label_threat", f"SELECT event_id, {LABELLED} AS threat FROM (SELECT event_id, event_id % {len(LABELS)} AS i FROM events)")
def label_threat(spark, sf):
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("event_id") % len(LABELS) + 1).cast("int"))
    return T.table(spark, sf, "events").select("event_id", PR.label_threat(label).alias("threat"))


CIPHERS = [0x0005, 0x1301, 0xC02F, 0x009C, 0x0033, 0x0014, 0xC012, 0xC013, 0x1302, 0x0032]
WEAK = " OR ".join(f"x BETWEEN {lo} AND {hi}" for lo, hi in PR.WEAK_CIPHERS)


def cipher(k):
    return F.element_at(F.array(*[F.lit(c) for c in CIPHERS]), (k % 10 + 1).cast("int"))


@register("H43_weak_cipher", f"SELECT event_id, ({WEAK}) AS weak FROM (SELECT event_id, list_extract({CIPHERS}, CAST(event_id % 10 + 1 AS INTEGER)) AS x FROM events)")
def weak_cipher(spark, sf):
    return T.table(spark, sf, "events").select("event_id", PR.weak_cipher(cipher(F.col("event_id"))).alias("weak"))


@register("H44_tls_attacks", f"""WITH {D}, t AS (SELECT event_id, list_extract({CIPHERS}, CAST(event_id % 10 + 1 AS INTEGER)) AS a, list_extract({CIPHERS}, CAST(port % 10 + 1 AS INTEGER)) AS b, 768 + port % 5 AS v, port % 7 AS j, user_id % 3 AS u FROM det),
 w AS (SELECT *, ({WEAK.replace('x BETWEEN', 'a BETWEEN')}) AS wa, ({WEAK.replace('x BETWEEN', 'b BETWEEN')}) AS wb FROM t)
 SELECT event_id, 'client:TlsWeakCipher' AS detection FROM w WHERE wa OR wb UNION ALL SELECT event_id, 'client:TlsDowngrade' FROM w WHERE v < 771 UNION ALL SELECT event_id, 'client:TlsKnownMalwareJa3' FROM w WHERE j = 3
 UNION ALL SELECT event_id, 'server:TlsWeakCipher' FROM w WHERE wb UNION ALL SELECT event_id, 'server:TlsDowngrade' FROM w WHERE v < 771 UNION ALL SELECT event_id, 'cert:TlsSelfSigned' FROM w WHERE u = 0 UNION ALL SELECT event_id, 'cert:TlsExpiredCert' FROM w WHERE u = 1""")
def tls_attacks(spark, sf):
    a, b, v = cipher(F.col("event_id")), cipher(F.col("port")), F.lit(768) + F.col("port") % 5
    issuer = F.when(F.col("user_id") % 3 == 0, "CN=x").otherwise("CN=ca")
    parts = {
        "client": PR.client_hello(F.array(a, b), F.array(F.lit(768), v), F.concat(F.lit("ja3-"), (F.col("port") % 7).cast("string")), ["ja3-3"]), "server": PR.server_hello(b, v),
        "cert": PR.certificate(F.lit("CN=x"), issuer, F.when(F.col("user_id") % 3 == 1, "Jan 1 1970").otherwise("Jan 1 2030")),
    }

    def told(side):
        return lambda d: F.concat(F.lit(f"{side}:"), d)

    every = F.concat(*[F.transform(x, told(side)) for side, x in parts.items()])
    return T.detections(spark, sf).select("event_id", F.explode(every).alias("detection"))


@register("H95_tls_probe", f"WITH {D} SELECT event_id, (port % 20 < 5 OR user_id % 9 < 3 OR (768 + port % 5 < 771 AND event_id % 2 = 0)) AS probe FROM det")
def tls_probe(spark, sf):
    versions = F.when(F.col("event_id") % 2 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(771)))
    return T.detections(spark, sf).select("event_id", PR.tls_probe(F.col("port") % 20, F.col("user_id") % 9, F.lit(768) + F.col("port") % 5, versions).alias("probe"))


@register("H37_ssh_version", f"""WITH {D} SELECT event_id, CASE port % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS protocol, CASE port % 4 WHEN 0 THEN 'OpenSSH_' || port WHEN 1 THEN 'dropbear-x' END AS software,
 CASE port % 4 WHEN 0 THEN 'Ubuntu-3 (' || event_type || ')' END AS comments, CASE port % 4 WHEN 0 THEN 'Ubuntu' END AS os FROM det""")
def ssh_version(spark, sf):
    k = F.col("port") % 4
    line = F.when(k == 0, F.concat(F.lit("SSH-2.0-OpenSSH_"), F.col("port").cast("string"), F.lit(" Ubuntu-3 ("), "event_type", F.lit(")"))).when(k == 1, "SSH-1.99-dropbear-x").when(k == 2, "SSH-3.0-x").otherwise("HTTP/1.1 200")
    return T.detections(spark, sf).select("event_id", PR.ssh_version(line).alias("v")).select("event_id", "v.protocol", "v.software", "v.comments", "v.os")


SPAM, PHISH = ["viagra", "lottery", "free money"], ["verify your account", "password expired"]


@register("H34_mail_rules", f"WITH {D} SELECT event_id, (port % 6 = 0 OR port > 50) AS spam, (port % 6 = 1 OR user_id % 4 <> event_id % 4 OR user_id % 11 = 0) AS phishing, (port % 5 = 0 OR user_id % 7 = 0 OR port > 20) AS anomaly FROM det")
def mail_rules(spark, sf):
    """Rows H34, H35 and H36."""
    k = F.col("port") % 6
    subject = F.when(k == 0, "You won the LOTTERY").when(k == 1, "Please Verify your Account").when(k == 2, F.lit(None).cast("string")).otherwise("minutes")
    head = F.concat(F.lit("Bob <bob@D"), (F.col("user_id") % 4).cast("string"), F.lit(".example>"))
    envelope = F.concat(F.lit("x@d"), (F.col("event_id") % 4).cast("string"), F.lit(".example"))
    gone = F.lit(None).cast("string")
    return T.detections(spark, sf).select(
        "event_id", PR.mail_spam(subject, F.col("port"), SPAM).alias("spam"), PR.mail_phishing(subject, head, envelope, PHISH, F.col("user_id") % 11 == 0).alias("phishing"),
        PR.mail_header_anomaly(F.when(F.col("port") % 5 == 0, gone).otherwise(head), F.when(F.col("user_id") % 7 == 0, gone).otherwise("now"), F.col("port")).alias("anomaly"),
    )


@register("H45_dns_attacks", f"WITH {D} SELECT event_id, 'DnsTunneling' AS detection FROM det WHERE port % 9 = 0 UNION ALL SELECT event_id, 'DnsDga' FROM det WHERE user_id % 5 = 0 UNION ALL SELECT event_id, 'DnsAmplification' FROM det WHERE event_id % 2 = 0 AND port % 4 > 0 AND port > 10")
def dns_attacks(spark, sf):
    d = PR.dns_attacks(F.col("port") % 9 == 0, F.col("user_id") % 5 == 0, F.col("event_id") % 2 == 0, F.col("port") % 4, F.col("port"))
    return T.detections(spark, sf).select("event_id", F.explode(d).alias("detection"))


@register("H65_csv_fields", "SELECT event_id, event_type || ', \"q\"' AS a, CAST(value AS VARCHAR) AS b FROM events")
def csv_fields(spark, sf):
    quoted = F.concat(F.lit('"'), "event_type", F.lit(', ""q"""'))
    line = F.concat(quoted, F.lit(","), F.format_number(F.lit(0), 0), F.lit(","), F.col("event_id").cast("string"))
    fields = F.from_csv(line, F.lit("a string, zero int, id bigint"), {"escape": '"'})
    e = T.table(spark, sf, "events").select("event_id", "value", fields.alias("f"))
    return e.filter("f.id = event_id AND f.zero = 0").select("event_id", F.col("f.a").alias("a"), F.col("value").cast("string").alias("b"))


PAYLOADS = ["GET / HTTP/1.1", "HTTP/1.1 200 OK", "SSH-2.0-x", "\\x16\\x03\\x01", "", "0123456789ab"]
BY_PORT = "CASE WHEN p IN (80, 8080) THEN 'Http' WHEN p = 443 THEN 'Https' WHEN p = 22 THEN 'Ssh' WHEN p = 53 THEN 'Dns' ELSE 'Unknown' END"


@register("H81_detect_protocol", f"WITH {P}, t AS (SELECT packet_id, packet_id % 6 AS i, dst_port AS p FROM pkt) SELECT packet_id, CASE i WHEN 0 THEN 'Http' WHEN 1 THEN 'Http' WHEN 2 THEN 'Ssh' WHEN 3 THEN 'Https' WHEN 4 THEN 'Unknown' ELSE {BY_PORT} END AS protocol FROM t WHERE i <> 0 OR p <> 0")
def detect_protocol(spark, sf):
    i = F.col("packet_id") % 6
    body = F.when(i == 0, F.lit("GET / HTTP/1.1").cast("binary")).when(i == 1, F.lit("HTTP/1.1 200 OK").cast("binary")).when(i == 2, F.lit("SSH-2.0-x").cast("binary")).when(i == 3, F.unhex(F.lit("160301"))).when(i == 4, F.lit("").cast("binary")).otherwise(F.lit("0123456789ab").cast("binary"))
    p = F.col("dst_port")
    by_port = F.when(p.isin(80, 8080), "Http").when(p == 443, "Https").when(p == 22, "Ssh").when(p == 53, "Dns").otherwise("Unknown")
    return T.packets(spark, sf).filter((i != 0) | (p != 0)).select("packet_id", PR.detect_protocol(body, p, by_port).alias("protocol"))


@register("B27_enabled_stages", f"WITH {D} SELECT event_id, severity, port FROM det WHERE severity >= 1 AND port % 2 = 0")
def enabled_stages(spark, sf):
    stages = [("ipfilter", lambda d: d.filter("port % 2 = 0")), ("ml", lambda d: d.filter("port % 3 = 0")), ("correlation", lambda d: d.filter("severity >= 1"))]
    out = T.detections(spark, sf)
    for _, stage in PR.stages_enabled({"ipfilter": True, "correlation": True, "ml": False}, stages):
        out = stage(out)
    return out.select("event_id", "severity", "port")


@register("A51_audit_record", f"WITH {D}, k AS (SELECT event_id, event_type, severity, port, count(*) OVER (PARTITION BY user_id, ts) AS n FROM det) SELECT event_id AS packet_id, CASE WHEN severity >= 3 THEN 'drop' ELSE 'allow' END AS verdict, 2 AS stages_run, severity AS max_severity, event_type AS first_type, coalesce(nullif(port, 0), 0) * 10 AS processing_us FROM k")
def audit_record(spark, sf):
    d = T.detections(spark, sf)
    record = PR.audit_record(
        F.col("event_id"), F.array(F.lit("ipfilter"), F.lit("flows")), F.array(F.struct(F.col("event_type").alias("type"), F.col("severity").alias("severity"))),
        F.when(F.col("severity") >= 3, "drop").otherwise("allow"), F.nullif(F.col("port"), F.lit(0)) * 10,
    )
    r = d.select(record.alias("r"))
    return r.select("r.packet_id", "r.verdict", "r.stages_run", "r.max_severity", F.element_at("r.event_types", 1).alias("first_type"), "r.processing_us")
