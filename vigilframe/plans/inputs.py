"""Rule sets merged by id, access logs behind proxies, and protocols of payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probes as PB
from ..operators import lookups as L
from ..operators import proxy_log, rules
from ..sources import tables as T
from ..sources.scratch import as_text
from .registry import register


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def rule_set(spark: SparkSession, lines: DataFrame, disabled: int) -> DataFrame:
    """Rules of text files that are written first; a sid divisible by `disabled` is off."""
    r = rules.parse_rules(spark.read.text(as_text(lines)))
    return r.select("sid", "rev", "action", "proto", "msg", "contents", "keywords", (F.col("sid") % disabled != 0).alias("enabled"))


@register("G02_keyed_merge", """WITH a AS (SELECT c_custkey AS sid, 'alert' AS action, CASE WHEN c_custkey % 4 = 0 THEN 'http' ELSE 'tcp' END AS proto, true AS content, c_custkey % 6 = 0 AS pcre, true AS flow, c_custkey % 7 <> 0 AS enabled, true AS fast FROM customer),
 b AS (SELECT c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 1000000 ELSE 0 END AS sid, 'drop' AS action, 'udp' AS proto, c_custkey % 2 = 0 AS content, false AS pcre, false AS flow,
              (c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 1000000 ELSE 0 END) % 11 <> 0 AS enabled, false AS fast FROM customer WHERE c_custkey % 3 = 0),
 m AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE sid NOT IN (SELECT sid FROM b))
 SELECT name, count(*) AS n FROM (SELECT unnest(list_filter(['total', 'action:' || action, 'protocol:' || proto, CASE WHEN content THEN 'with_content' END, CASE WHEN pcre THEN 'with_pcre' END, CASE WHEN flow THEN 'with_flow' END,
   CASE WHEN NOT enabled THEN 'disabled' END, CASE WHEN fast THEN 'fast_patterns' END], lambda x: x IS NOT NULL)) AS name FROM m) GROUP BY name""")
def keyed_merge(spark, sf):
    """Two rule files, the second with new and changed rules, merged by sid; totals of what stays."""
    k = F.col("c_custkey")
    c = T.table(spark, sf, "customer").select("c_custkey")
    pcre = F.when(k % 6 == 0, ' pcre:"/x/i";').otherwise("")
    one = text("alert ", F.when(k % 4 == 0, "http").otherwise("tcp"), ' any any -> any any (msg:"m"; flow:to_server; content:"abc";', pcre, " sid:", k, "; rev:1;)")
    sid = k + F.when(k % 5 == 0, 1_000_000).otherwise(0)
    content = F.when(k % 2 == 0, ' content:!"abc";').otherwise("")
    two = text('drop udp any any -> any any (msg:"n";', content, " sid:", sid, "; rev:2;)")
    first, second = rule_set(spark, c.select(one.alias("value")), 7), rule_set(spark, c.filter(k % 3 == 0).select(two.alias("value")), 11)
    return rules.rule_totals(rules.merge_rule_sets([first, second], "rev"))


PROXIES = ["104.16.0.0/13", "172.64.0.0/13", "10.9.8.7"]
IN_PROXY = "({0} BETWEEN 1745879040 AND 1746403327 OR {0} BETWEEN 2889875456 AND 2890399743 OR {0} = 168364039)"
NUM = "list_sum(list_transform(string_split({0}, '.'), lambda p, i: p::BIGINT * [16777216, 65536, 256, 1][i]))"


@register("H89_proxy_log", f"""WITH l AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '104.17.' || user_id % 256 || '.9' WHEN event_id % 3 = 1 THEN '172.71.0.' || event_id % 256 ELSE '198.51.100.' || event_id % 256 END AS proxy_ip,
         CASE event_id % 5 WHEN 0 THEN ['10.9.8.7', '203.0.113.' || event_id % 250, '8.8.8.8'] WHEN 1 THEN ['unknown', '104.20.0.1'] WHEN 2 THEN ['-'] WHEN 3 THEN ['192.0.2.' || event_id % 250, '104.16.0.1'] END AS xff,
         event_id % 5 = 4 AS plain, CASE WHEN event_id % 40 = 0 THEN 'x' ELSE (200 + event_id % 300)::VARCHAR END AS status, event_type FROM events WHERE event_id % 50 <> 49),
 p AS (SELECT *, {IN_PROXY.format(NUM.format("proxy_ip"))} AS is_proxy, list_filter(coalesce(xff, []), lambda x: regexp_matches(x, '^[0-9.]+$') AND NOT {IN_PROXY.format(NUM.format("CASE WHEN regexp_matches(x, '^[0-9.]+$') THEN x ELSE '0.0.0.0' END"))})[1] AS own FROM l)
 SELECT event_id, proxy_ip, CASE WHEN is_proxy THEN own END AS real_ip, is_proxy, 'GET /' || event_type || ' HTTP/1.1' AS request, coalesce(TRY_CAST(status AS INTEGER), 0) AS status, CASE WHEN plain THEN 'ref' ELSE 'agent' END AS user_agent,
        CASE WHEN is_proxy AND own IS NOT NULL THEN own ELSE proxy_ip END AS effective_ip FROM p""")
def proxied_log(spark, sf):
    e, i = T.table(spark, sf, "events"), F.col("event_id")
    ip = F.when(i % 3 == 0, text("104.17.", F.col("user_id") % 256, ".9")).when(i % 3 == 1, text("172.71.0.", i % 256)).otherwise(text("198.51.100.", i % 256))
    xff = F.when(i % 5 == 0, text("10.9.8.7, 203.0.113.", i % 250, ", 8.8.8.8")).when(i % 5 == 1, "unknown,104.20.0.1").when(i % 5 == 2, "-").when(i % 5 == 3, text("192.0.2.", i % 250, ", 104.16.0.1"))
    status = F.when(i % 40 == 0, "x").otherwise((200 + i % 300).cast("string"))
    line = text(ip, ' - - [01/Jan/2024:00:00:00] "GET /', F.col("event_type"), ' HTTP/1.1" ', status, ' 17 "ref" "agent"', F.coalesce(F.concat(F.lit(' "'), xff, F.lit('"')), F.lit("")))
    lines = e.select("event_id", F.when(i % 50 == 49, "no log line").otherwise(line).alias("value"))
    nets = L.cidr_bounds(spark.createDataFrame([(p,) for p in PROXIES], "net string"), "net")
    return proxy_log.parse_proxy_log(lines, nets, "event_id")


#: Beginnings of payloads in hex; the text of a document follows.
HEADS = [
    b"GET /a HTTP/1.1\r\n".hex(), b"HTTP/1.1 200 OK\r\n".hex(), "1603030040", b"SSH-2.0-x\r\n".hex(), "0000010008", b"ehlo host\r\n".hex(), "00000055FE534D42", "05000B0310", b"user joe\r\n".hex(), "03000013", "000100000006", "056405C0",
    b"RFB 003.008\n".hex(), "", b"INVITE sip:a".hex(), "6B82", "302602", "002000000000000000", "120034", b"220 hi".hex(), "65000400", "0000000000000000000000000000000000200000", "0101000000010000000000000000",
]
HEADS = [h.upper() for h in HEADS]


def _byte(i: int, n: int = 1) -> str:
    return f"(CASE WHEN n >= {i + n} THEN ('0x' || substr(h, {2 * i + 1}, {2 * n}))::BIGINT END)"


def _starts(words: list[str], column: str = "h") -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{w.encode().hex().upper()}')" for w in words) + ")"


PROBE_SQL = [
    ("http", f"CASE WHEN (n >= 4 AND {_starts(PB.HTTP_METHODS)}) OR {_starts(['HTTP/'])} THEN 100 END"), ("dns", f"CASE WHEN n >= 12 AND {_byte(4, 2)} <= 20 AND {_byte(6, 2)} <= 50 THEN 70 END"),
    ("tls", f"CASE WHEN n >= 5 AND {_byte(0)} = 22 AND {_byte(1, 2)} BETWEEN 768 AND 772 THEN 100 END"), ("ssh", f"CASE WHEN {_starts(['SSH-'])} THEN 100 WHEN n >= 5 AND {_byte(0, 4)} BETWEEN 1 AND 262143 AND {_byte(4)} >= 4 THEN 90 END"),
    ("smtp", f"CASE WHEN {_starts(['220 ', '220-'])} OR {_starts(PB.SMTP_COMMANDS, 'u')} THEN 100 END"), ("smb", "CASE WHEN substr(h, 9, 8) IN ('FF534D42', 'FE534D42') OR substr(h, 1, 8) IN ('FF534D42', 'FE534D42') THEN 100 END"),
    ("dcerpc", f"CASE WHEN n >= 24 AND {_byte(0)} = 5 AND {_byte(1)} < 2 THEN 100 END"), ("ftp", f"CASE WHEN n >= 3 AND ({_starts(PB.FTP_COMMANDS, 'u')} OR regexp_matches(h, '^(3[0-9]){{3}}2[0D]')) THEN 90 END"),
    ("nfs", f"CASE WHEN n >= 28 AND {_byte(4, 4)} = 0 THEN 70 END"), ("kerberos", f"CASE WHEN n >= 4 AND {_byte(0)} BETWEEN 106 AND 110 THEN 90 END"), ("rdp", f"CASE WHEN n >= 4 AND {_byte(0)} = 3 THEN 80 END"),
    ("dhcp", "CASE WHEN n >= 240 AND substr(h, 473, 8) = '63825363' THEN 100 END"), ("snmp", f"CASE WHEN n >= 10 AND {_byte(0)} = 48 THEN 80 END"), ("sip", f"CASE WHEN {_starts([*PB.SIP_METHODS, 'SIP/'], 'u')} THEN 100 END"),
    ("mqtt", f"CASE WHEN n >= 2 AND {_byte(0)} >= 16 THEN 70 END"), ("modbus", f"CASE WHEN n >= 8 AND {_byte(2, 2)} = 0 THEN 80 END"), ("dnp3", "CASE WHEN n >= 10 AND starts_with(h, '0564') THEN 90 END"),
    ("tftp", f"CASE WHEN n >= 4 AND {_byte(0, 2)} BETWEEN 1 AND 6 THEN 80 END"), ("ntp", f"CASE WHEN n >= 48 AND ({_byte(0)} >> 3) & 7 BETWEEN 1 AND 4 THEN 85 WHEN n >= 8 AND {_byte(0)} & 7 = 7 THEN 70 END"),
    ("enip", f"CASE WHEN n >= 24 AND {_byte(1)} * 256 + {_byte(0)} IN ({', '.join(map(str, PB.ENIP_COMMANDS))}) THEN 85 END"), ("rfb", f"CASE WHEN n >= 12 AND {_starts(['RFB '])} THEN 100 END"),
    ("ike", f"CASE WHEN n >= 28 AND {_byte(17)} IN (16, 32) THEN 90 WHEN n >= 32 AND {_byte(0, 4)} = 0 AND {_byte(21)} IN (16, 32) THEN 85 END"),
]


@register("H82_probe_registry", f"""WITH p AS (SELECT doc_id, ({HEADS})[doc_id % {len(HEADS)} + 1] || hex(coalesce(text, '')) AS h FROM documents),
 q AS (SELECT doc_id, h, length(h) // 2 AS n, array_to_string(list_transform(range(0, least(24, length(h) // 2)), lambda i: CASE WHEN substr(h, 2 * i + 1, 2) BETWEEN '61' AND '7A' AND substr(h, 2 * i + 1, 1) IN ('6', '7')
        THEN upper(printf('%02x', ('0x' || substr(h, 2 * i + 1, 2))::INTEGER - 32)) ELSE substr(h, 2 * i + 1, 2) END), '') AS u FROM p),
 r AS (SELECT doc_id, list_max([{", ".join(f"{{'c': coalesce({c}, 0), 'o': {-i}, 'p': '{name}'}}" for i, (name, c) in enumerate(PROBE_SQL))}]) AS best FROM q)
 SELECT doc_id, CASE WHEN best.c > 0 THEN best.p END AS protocol, CASE WHEN best.c > 0 THEN best.c END AS confidence FROM r""")
def probe_registry(spark, sf):
    heads = F.array(*[F.lit(h) for h in HEADS])
    head = F.unhex(F.element_at(heads, (F.col("doc_id") % len(HEADS) + 1).cast("int")))
    d = T.table(spark, sf, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit("")).cast("binary")).alias("b"))
    return d.select("doc_id", PB.best_probe(F.col("b")).alias("p")).select("doc_id", "p.protocol", "p.confidence")
