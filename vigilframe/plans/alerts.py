"""Alerts of protocols from the state of flows, spoofed sources, ICMP rates and access points, with the default limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import protocol_alerts as PA
from ..operators import watch as W
from ..sources import tables as T
from .anomalies import ENDINGS, PIPES, SHARES, SMB_OPS
from .registry import register

D, P = T.DETECTIONS, T.PACKETS


def picked(values: tuple, by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def out(state: DataFrame, alerts) -> DataFrame:
    return state.select("src", F.explode(alerts).alias("a")).select("src", "a.severity", "a.message")


def listed(cases: list[tuple[str, str, str]]) -> str:
    """SQL of a list of alerts: condition, severity, message."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {{'s': '{s}', 'm': {m}}} END" for c, s, m in cases) + "], lambda x: x IS NOT NULL)"


def chosen(values, by: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[{by} % {len(values)} + 1]"


NAMES = ("www.example.com", "a.b.c.d.e.f.g.example.com", "cdn.example.top", "x.tk", "abcdefghijklmnopqrstuvwxyz0123456.example.com")
TUNNEL = "(len(string_split(name, '.')) > 7 OR len(list_filter(string_split(name, '.'), lambda x: length(x) > 63 OR (length(x) > 30 AND len(list_distinct(string_split(x, ''))) / length(x) > 0.7))) > 0 OR (kind IN ('TXT', 'ANY') AND length(name) > 100))"


@register("B45_dns_state_alerts", f"""WITH {D}, m AS (SELECT src, event_id % 3 = 0 AS response, port % 5 AS rcode, {chosen(NAMES, "(event_id * 7 + port * port % 3)")} AS name, CASE WHEN port % 7 = 0 THEN 'TXT' ELSE 'A' END AS kind FROM det),
 s AS (SELECT src, count(*) FILTER (NOT response) AS q, count(*) FILTER (response AND rcode <> 3) AS nx, bool_or(NOT response AND {TUNNEL}) AS tunnel, count(*) FILTER (NOT response AND regexp_matches(name, '\\.(tk|ml|ga|cf|gq|top|xyz|loan|work|onion)$')) AS bad FROM m GROUP BY src)
 SELECT src, a.s AS severity, a.m AS message FROM (SELECT src, unnest({listed([("tunnel", "High", "'DNS tunneling detected - potential data exfiltration'"), ("q >= 10 AND nx / q > 0.5", "High", "'Potential DGA activity - ' || nx || ' NXDOMAIN out of ' || q || ' queries'"), ("bad > 0", "Medium", "'Queries to suspicious TLD: ' || bad"), ("q > 100", "Low", "'High DNS query rate: ' || q || ' queries'")])}) AS a FROM s)""")
def dns_state_alerts(spark, sf):
    """Here three of four answers say that there is no such name."""
    d, port = T.detections(spark, sf), F.col("port")
    rcode = F.when(port % 5 == 3, 0).otherwise(3)
    m = d.select("src", (F.col("event_id") % 3 == 0).alias("response"), rcode.alias("rcode"), picked(NAMES, F.col("event_id") * 7 + port * port % 3).alias("name"), F.when(port % 7 == 0, "TXT").otherwise("A").alias("kind"))
    s = PA.dns_state(m, ["src"])
    return out(s, PA.dns_alerts(s))


USERS = ("root", "bob", "admin", "Root", "eve")


@register("B46_ssh_state_alerts", f"""WITH {D}, s AS (SELECT src, min(1 + port % 2) AS protocol, max(CASE WHEN port = 77 THEN 'hash' || port END) AS hassh, max(CASE WHEN port = 13 THEN 'scanner' END) AS software,
   list_sort(list_distinct(list(CASE WHEN port % 25 = 3 THEN 'alg' || port END) FILTER (port % 25 = 3))) AS weak, list_sort(list_distinct(list('CVE-' || port) FILTER (port % 50 = 7))) AS cves, 'OpenSSH_' || max(port) AS version,
   count(*) FILTER (event_type = 'error') AS failures, arg_max({chosen(USERS, "event_id")}, (ts, event_id)) AS username FROM det GROUP BY src)
 SELECT src, a.s AS severity, a.m AS message FROM (SELECT src, unnest({listed([("protocol = 1", "Critical", "'Deprecated SSH-1 protocol detected'"), ("hassh IS NOT NULL", "High", "'Suspicious SSH HASSH fingerprint: ' || hassh"), ("software IS NOT NULL", "Medium", "'Suspicious SSH client software: ' || software"), ("len(weak) > 0", "Medium", "'Weak SSH algorithms detected: ' || array_to_string(weak, ', ')"), ("len(cves) > 0", "High", "'Vulnerable SSH version: ' || version || ' (CVEs: ' || array_to_string(cves, ', ') || ')'"), ("failures >= 3", "High", "'SSH brute force attempt: ' || failures || ' failures'"), ("username IN ('root', 'admin', 'administrator')", "Medium", "'SSH privileged account login attempt: ' || username")])}) AS a FROM s)""")
def ssh_state_alerts(spark, sf):
    d, port = T.detections(spark, sf), F.col("port")
    names = lambda test, value: F.sort_array(F.collect_set(F.when(test, value)))  # noqa: E731  a hundred ports at most
    s = d.groupBy("src").agg(
        F.min(1 + port % 2).alias("protocol"), F.max(F.when(port == 77, F.concat(F.lit("hash"), port.cast("string")))).alias("bad_hassh"), F.max(F.when(port == 13, "scanner")).alias("bad_software"),
        names(port % 25 == 3, F.concat(F.lit("alg"), port.cast("string"))).alias("weak"), names(port % 50 == 7, F.concat(F.lit("CVE-"), port.cast("string"))).alias("cves"), F.concat(F.lit("OpenSSH_"), F.max(port).cast("string")).alias("software"),
        F.count_if(F.col("event_type") == "error").alias("failures"), F.max_by(picked(USERS, F.col("event_id")), F.struct("ts", "event_id")).alias("username"),
    )
    return out(s, PA.ssh_alerts(s))


@register("B47_smtp_state_alerts", f"""WITH {D}, s AS (SELECT src, list_sort(list_distinct(list('f' || port || '.exe') FILTER (port % 33 = 5))) AS att, list_sort(list_distinct(list('spam' || port % 4) FILTER (port % 20 = 1))) AS spam, list_sort(list_distinct(list('phish' || port) FILTER (port = 42))) AS phish,
   bool_or(port = 9 AND severity = 3) AS spoofed, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'click') AS tx, count(*) FILTER (port > 20) AS rcpt, max(CASE WHEN user_id % 3 = 0 THEN 'u' || user_id END) AS username, bool_or(user_id % 2 = 0) AS tls FROM det GROUP BY src)
 SELECT src, a.s AS severity, a.m AS message FROM (SELECT src, unnest({listed([("len(att) > 0", "High", "'Dangerous email attachment: ' || array_to_string(att, ', ')"), ("len(spam) > 0", "Medium", "'Spam indicators detected: ' || array_to_string(spam, ', ')"), ("len(phish) > 0", "High", "'Phishing indicators detected: ' || array_to_string(phish, ', ')"), ("spoofed", "High", "'Email spoofing detected (SPF/DKIM/DMARC failure)'"), ("failures >= 3", "High", "'SMTP authentication brute force: ' || failures || ' failures'"), ("tx >= 10 OR rcpt >= 50", "Medium", "'Mass mailer detected: ' || tx || ' transactions, ' || rcpt || ' recipients'"), ("username IS NOT NULL AND NOT tls", "Medium", "'SMTP authentication without TLS - credentials may be exposed'")])}) AS a FROM s)""")
def smtp_state_alerts(spark, sf):
    d, port = T.detections(spark, sf), F.col("port")
    names = lambda test, *value: F.sort_array(F.collect_set(F.when(test, F.concat(*value))))
    text = lambda c: c.cast("string")
    s = d.groupBy("src").agg(
        names(port % 33 == 5, F.lit("f"), text(port), F.lit(".exe")).alias("attachments"), names(port % 20 == 1, F.lit("spam"), text(port % 4)).alias("spam"), names(port == 42, F.lit("phish"), text(port)).alias("phishing"),
        F.bool_or((port == 9) & (F.col("severity") == 3)).alias("spoofed"), F.count_if(F.col("event_type") == "error").alias("failures"), F.count_if(F.col("event_type") == "click").alias("transactions"), F.count_if(port > 20).alias("recipients"),
        F.max(F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("u"), text(F.col("user_id"))))).alias("username"), F.bool_or(F.col("user_id") % 2 == 0).alias("tls"),
    )
    return out(s, PA.smtp_alerts(s))


SMB_PIPE = " OR ".join(f"contains(lower(x), '\\pipe\\{p}')" for p in W.ADMIN_PIPES)


@register("B48_smb_state_alerts", f"""WITH {D}, m AS (
  SELECT event_id, src, ts, port, {chosen(SMB_OPS, "event_id")} AS op, port % 4 AS id,
         CASE {chosen(SMB_OPS, "event_id")} WHEN 'tree_connect' THEN {chosen(SHARES, "port")} WHEN 'pipe' THEN {chosen(PIPES, "port")} WHEN 'open' THEN 'f' || event_id || {chosen(ENDINGS, "port")} END AS name FROM det),
 last AS (SELECT src, CASE WHEN op = 'pipe' THEN 'pipe' ELSE 'tree' END AS what, id, arg_max(CASE WHEN op IN ('pipe', 'tree_connect') THEN name ELSE '' END, (ts, event_id)) AS name FROM m WHERE op IN ('tree_connect', 'tree_disconnect', 'pipe') GROUP BY ALL),
 held AS (SELECT src, list_sort(list(name) FILTER (what = 'tree' AND name <> '')) AS shares, list_sort(list(name) FILTER (what = 'pipe')) AS pipes FROM last GROUP BY src),
 c AS (SELECT src, bool_or(port = 50) AS smb1, count(*) FILTER (op = 'auth_failure') AS failures, count(*) FILTER (op = 'open' AND regexp_matches(lower(name), '\\.(locked|enc)$')) AS bad, count(*) FILTER (op = 'open') AS files FROM m GROUP BY src),
 s AS (SELECT c.*, coalesce(shares, []) AS shares, coalesce(pipes, []) AS pipes, len(list_filter(coalesce(shares, []), lambda x: regexp_matches(lower(x), '(^|\\\\)(c|admin|ipc)\\$$'))) + len(list_filter(coalesce(pipes, []), lambda x: {SMB_PIPE})) > 0 AS moves FROM c LEFT JOIN held USING (src)),
 a AS (SELECT src, unnest(list_concat({listed([("smb1", "Medium", "'SMB1 protocol detected - legacy and vulnerable'"), ("failures >= 5", "High", "'SMB authentication brute force detected - ' || failures || ' failures'"), ("moves", "High", "'Potential lateral movement via SMB detected'"), ("bad > 5 OR files > 100", "Critical", "'Potential ransomware activity - ' || bad || ' suspicious files accessed'")])},
   list_transform(list_filter(shares, lambda x: regexp_matches(lower(x), 'admin\\$$')), lambda x: {{'s': 'High', 'm': 'Admin share access: ' || x}}), list_transform(list_filter(shares, lambda x: regexp_matches(lower(x), '[cd]\\$$')), lambda x: {{'s': 'Medium', 'm': 'Hidden drive share access: ' || x}}),
   list_transform(list_filter(pipes, lambda x: {SMB_PIPE}), lambda x: {{'s': 'Medium', 'm': 'Suspicious named pipe access: ' || x}}))) AS a FROM s)
 SELECT src, a.s AS severity, a.m AS message FROM a""")
def smb_state_alerts(spark, sf):
    op, port = picked(SMB_OPS, F.col("event_id")), F.col("port")
    name = F.when(op == "tree_connect", picked(SHARES, port)).when(op == "pipe", picked(PIPES, port)).when(op == "open", F.concat(F.lit("f"), F.col("event_id").cast("string"), picked(ENDINGS, port)))
    m = T.detections(spark, sf).select("event_id", "src", "ts", "port", op.alias("op"), (port % 4).alias("id"), name.alias("name"))
    last = W.smb_state(m, ["src"], ["ts", "event_id"]).groupBy("src").agg(F.max_by(F.struct("failures", "lateral", "ransomware", "suspicious"), F.struct("ts", "event_id")).alias("s"), F.bool_or(F.col("port") == 50).alias("smb1"))
    what = F.when(F.col("op") == "pipe", "pipe").when(F.col("op").startswith("tree"), "tree")
    held = m.withColumn("what", what).filter("what IS NOT NULL").groupBy("src", "what", "id").agg(F.max_by(F.struct("op", "name"), F.struct("ts", "event_id")).alias("l"))
    names = lambda kind: F.sort_array(F.collect_list(F.when((F.col("what") == kind) & (F.col("l.op") != "tree_disconnect"), F.col("l.name"))))  # noqa: E731  ids of a session
    held = held.groupBy("src").agg(names("tree").alias("shares"), names("pipe").alias("pipes"))
    s = last.join(held, "src", "left").select("src", "smb1", "s.*", "shares", "pipes")
    return out(s, PA.smb_alerts(s))


@register("B49_tls_state_alerts", f"""WITH {D}, s AS (SELECT src, max(CASE WHEN port = 31 THEN 'ja3-' || port END) AS ja3, arg_max(768 + port % 5, (ts, event_id)) AS version FROM det GROUP BY src)
 SELECT src, a.s AS severity, a.m AS message FROM (SELECT src, unnest({listed([("ja3 IS NOT NULL", "High", "'Suspicious JA3 fingerprint detected: ' || ja3"), ("version < 771", "Medium", "'Deprecated TLS version: ' || version")])}) AS a FROM s)""")
def tls_state_alerts(spark, sf):
    d, port = T.detections(spark, sf), F.col("port")
    s = d.groupBy("src").agg(F.max(F.when(port == 31, F.concat(F.lit("ja3-"), port.cast("string")))).alias("bad_ja3"), F.max_by(768 + port % 5, F.struct("ts", "event_id")).alias("version"))
    return out(s, PA.tls_alerts(s))


SOURCES = f"{P}, x AS (SELECT packet_id, user_id, (src_num * 2654435761 + packet_id * 40503) % 4294967296 AS src_num, CASE WHEN packet_id % 50 = 0 THEN (src_num * 2654435761 + packet_id * 40503) % 4294967296 ELSE dst_num END AS dst_num, src_port, CASE WHEN packet_id % 50 = 0 THEN src_port ELSE dst_port END AS dst_port FROM pkt)"
BAD = "({0} < 16777216 OR {0} BETWEEN 3221225472 AND 3221225727 OR {0} BETWEEN 3221225984 AND 3221226239 OR {0} BETWEEN 3323068416 AND 3323199487 OR {0} BETWEEN 3325256704 AND 3325256959 OR {0} BETWEEN 3405803776 AND 3405804031 OR {0} >= 3758096384 OR {0} BETWEEN 2130706432 AND 2147483647)"


@register("D50_spoof_features", f"WITH {SOURCES} SELECT user_id, round(count(*) FILTER ({BAD.format('src_num')}) / count(*), 6) AS bogon, 0.0::DOUBLE AS martian, 0.0::DOUBLE AS ttl_anomaly, max(CASE WHEN src_num = dst_num AND src_port = dst_port AND src_port <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS land FROM x GROUP BY user_id")
def spoof_features(spark, sf):
    """Packets with sources from all over the address space; every fiftieth has its source as its target. Martians are bogons first."""
    p = T.packets(spark, sf)
    src, again = (F.col("src_num") * 2654435761 + F.col("packet_id") * 40503) % 4294967296, F.col("packet_id") % 50 == 0
    x = p.select("user_id", src.alias("src_num"), F.when(again, src).otherwise(F.col("dst_num")).alias("dst_num"), "src_port", F.when(again, F.col("src_port")).otherwise(F.col("dst_port")).alias("dst_port"))
    return PA.spoof_features(x, ["user_id"]).select("user_id", *[F.round(c, 6).alias(c) for c in ("bogon", "martian", "ttl_anomaly", "land")])


HOUR = 3_600_000_000  # a second stands for an hour here, so that ten seconds hold messages


@register("D51_icmp_rates", f"""WITH RECURSIVE {D}, m AS (SELECT src, event_id, epoch_us(ts) AS us, ([3, 4, 5, 11, 8])[port % 5 + 1] AS type, row_number() OVER (PARTITION BY src ORDER BY ts, event_id) AS k FROM det),
 w AS (SELECT src, k, us AS start FROM m WHERE k = 1 UNION ALL SELECT m.src, m.k, CASE WHEN m.us > w.start + {10 * HOUR} THEN m.us ELSE w.start END FROM w JOIN m ON m.src = w.src AND m.k = w.k + 1),
 c AS (SELECT m.*, start, {", ".join(f"count(*) FILTER (type = {t}) OVER (PARTITION BY m.src, start ORDER BY m.k ROWS UNBOUNDED PRECEDING) AS {n}" for n, t in PA.ICMP_TYPES.items())} FROM m JOIN w ON w.src = m.src AND w.k = m.k)
 SELECT event_id, {", ".join(f"round({n} / greatest((us - start) / {HOUR}, 0.1), 5) AS {n}" for n in PA.ICMP_TYPES)} FROM c""")
def icmp_rates(spark, sf):
    d = T.detections(spark, sf)
    m = d.select("src", "event_id", F.unix_micros("ts").alias("us"), picked((3, 4, 5, 11, 8), F.col("port")).alias("type"))
    return PA.icmp_rates(m, ["src"], HOUR).select("event_id", *[F.round(n, 5).alias(n) for n in PA.ICMP_TYPES])


BEACONS = f"""{D}, b AS (SELECT event_id, epoch_us(ts) AS us, user_id AS bssid, 'net' || (user_id % 300 + CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END) AS ssid, CASE WHEN event_id % 3 <> 0 THEN port % 14 END AS channel, CASE WHEN event_id % 5 = 0 THEN 'rsn' || port END AS rsn, CASE WHEN event_id % 7 <> 0 THEN -port END AS signal FROM det)"""


@register("I47_access_points", f"""WITH {BEACONS}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w >= {300 * HOUR} THEN 1 ELSE 0 END AS gap FROM b WINDOW w AS (PARTITION BY bssid ORDER BY us, event_id)),
 r AS (SELECT *, sum(gap) OVER (PARTITION BY bssid ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g), l AS (SELECT * FROM r QUALIFY run = max(run) OVER (PARTITION BY bssid)),
 h AS (SELECT *, row_number() OVER (PARTITION BY bssid, signal IS NULL ORDER BY us DESC, event_id DESC) <= 10 AS recent FROM l),
 p AS (SELECT bssid, arg_min(ssid, (us, event_id)) AS ssid, coalesce(arg_max(channel, (us, event_id)) FILTER (channel IS NOT NULL), 0) AS channel, arg_max(rsn, (us, event_id)) FILTER (rsn IS NOT NULL) AS rsn, count(*) AS beacons,
         trunc(sum(signal) FILTER (recent) / count(signal) FILTER (recent))::INTEGER AS signal, bssid % 4 = 0 AS is_known, max(us) AS seen FROM h GROUP BY bssid),
 a AS (SELECT * FROM p WHERE (SELECT max(us) FROM b) - seen < {300 * HOUR}),
 n AS (SELECT DISTINCT l.bssid, l.ssid, a.is_known FROM l JOIN a USING (bssid)), t AS (SELECT ssid FROM n GROUP BY ssid HAVING bool_or(is_known) AND NOT bool_and(is_known))
 SELECT bssid, ssid, channel, rsn, beacons, signal, is_known, bssid IN (SELECT bssid FROM n JOIN t USING (ssid)) AS evil_twin FROM a""")
def access_points(spark, sf):
    d, e = T.detections(spark, sf), F.col("event_id")
    name = F.concat(F.lit("net"), (F.col("user_id") % 300 + F.when(e % 40 == 0, 1).otherwise(0)).cast("string"))
    b = d.select(
        "event_id", F.unix_micros("ts").alias("us"), F.col("user_id").alias("bssid"), name.alias("ssid"), F.when(e % 3 != 0, F.col("port") % 14).alias("channel"),
        F.when(e % 5 == 0, F.concat(F.lit("rsn"), F.col("port").cast("string"))).alias("rsn"), F.when(e % 7 != 0, -F.col("port")).alias("signal"),
    )
    end = b.agg(F.max("us")).first()[0]
    return PA.access_points(b, b.filter("bssid % 4 = 0").select("bssid"), F.lit(end).cast("long"), 300 * HOUR)


URIS, AGENTS = ("/a/../etc/passwd", "/q?x=1' or 'a", "/WP-ADMIN/x", "/plain", "/p?q=union select 1", "/also/plain"), ("Mozilla/5.0", "curl/8", "Safari", "Edge")
FIRST = "CASE " + " ".join(f"WHEN contains(lower({{0}}), '{p.lower().replace(chr(39), chr(39) * 2)}') THEN '{p.replace(chr(39), chr(39) * 2)}'" for p in PA.URI_PATTERNS) + " END"
QUOTED = "([" + ", ".join("'" + u.replace("'", "''") + "'" for u in URIS) + "])"


@register("B39_uri_patterns", f"WITH p AS (SELECT page_id, url || {QUOTED}[page_id % {len(URIS)} + 1] AS uri FROM pages) SELECT page_id, {FIRST.format('uri')} AS pattern, regexp_matches(lower(uri), '{'|'.join(PA.AGENT_PATTERNS)}') AS agent_like FROM p")
def uri_patterns(spark, sf):
    """The first suspicious pattern of each page's address with a path behind it, and whether it reads like a client that B40 names."""
    p = T.table(spark, sf, "pages").select("page_id", F.concat("url", picked(URIS, F.col("page_id"))).alias("uri"))
    return p.select("page_id", PA.uri_pattern(F.col("uri")).alias("pattern"), PA.suspicious_agent(F.col("uri")).alias("agent_like"))


@register("B44_http_state_alerts", f"""WITH {D}, m AS (SELECT src, ts, event_id, CASE WHEN event_id % 2 = 0 THEN {QUOTED}[user_id % {len(URIS)} + 1] END AS uri, CASE WHEN event_id % 2 = 0 THEN {chosen(AGENTS, "(event_id // 2)")} END AS agent, CASE WHEN event_id % 2 = 1 THEN 200 + port * 4 END AS status FROM det),
 f AS (SELECT *, {FIRST.format("uri")} AS p FROM m),
 s AS (SELECT src, bool_or(contains(p, '..')) AS traversal, bool_or(contains(p, '''') OR contains(p, 'UNION') OR contains(p, '1=1')) AS injection, bool_or(contains(lower(agent), 'curl')) AS bad, arg_max(agent, (ts, event_id)) FILTER (agent IS NOT NULL) AS agent, count(status) AS n, count(*) FILTER (status >= 400) AS e FROM f GROUP BY src)
 SELECT src, a.s AS severity, a.m AS message FROM (SELECT src, unnest({listed([("traversal", "High", "'HTTP path traversal attempt detected'"), ("injection", "High", "'HTTP SQL injection attempt detected'"), ("bad", "Medium", "'Suspicious HTTP User-Agent detected: ' || agent"), ("e > 10 AND e * 100 / n > 50", "Low", "'High HTTP error rate: ' || printf('%.1f%%', e * 100 / n)")])}) AS a FROM s)""")
def http_state_alerts(spark, sf):
    d, e = T.detections(spark, sf), F.col("event_id")
    m = d.select("src", "ts", "event_id", F.when(e % 2 == 0, picked(URIS, F.col("user_id"))).alias("uri"), F.when(e % 2 == 0, picked(AGENTS, F.floor(e / 2))).alias("agent"), F.when(e % 2 == 1, 200 + F.col("port") * 4).alias("status"))
    s = PA.http_state(m, ["src"], ["ts", "event_id"])
    return out(s, PA.http_alerts(s))
