"""Queries over texts, pages and URLs: HTTP scans, DNS and mail heuristics, sanitising, chunking, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import textscan as S
from ..sources import tables as T
from .registry import register

D = T.DETECTIONS
HOST = "lower(regexp_extract(url, '^https?://([^/:?]+)', 1))"


def docs(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def pages(spark, sf):
    return T.table(spark, sf, "pages")


def _q(s: str) -> str:
    return s.replace("'", "''")


HITS = ", ".join(f"CASE WHEN regexp_matches(lower(url), '{_q(p)}') THEN {{'c': '{c}', 's': {S.SEVERITY_SCORE[s]}, 'p': {S.ACTION_PRIORITY[a]}}} END" for c, s, a, p in S.HTTP_PATTERNS)


@register("H46_http_scan", f"WITH h AS (SELECT page_id, list_filter([{HITS}], lambda x: x IS NOT NULL) AS hits FROM pages) SELECT page_id, CAST(len(hits) AS INTEGER) AS n_hits, array_to_string(list_transform(hits, lambda x: x.c), ',') AS categories FROM h")
def http_scan(spark, sf):
    h = pages(spark, sf).withColumn("hits", S.match_list(F.lower("url"), S.HTTP_PATTERNS))
    return h.select("page_id", F.size("hits").alias("n_hits"), F.array_join(F.transform("hits", lambda x: x["category"]), ",").alias("categories"))


@register("H48_http_score", f"WITH h AS (SELECT page_id, list_filter([{HITS}], lambda x: x IS NOT NULL) AS hits FROM pages) SELECT page_id, CAST(coalesce(list_sum(list_transform(hits, lambda x: x.s)), 0) AS INTEGER) AS score FROM h")
def http_score(spark, sf):
    return pages(spark, sf).select("page_id", S.threat_score(S.match_list(F.lower("url"), S.HTTP_PATTERNS)).alias("score"))


@register("H49_http_action", f"WITH h AS (SELECT page_id, list_max(list_transform(list_filter([{HITS}], lambda x: x IS NOT NULL), lambda x: x.p)) AS p FROM pages) SELECT page_id, CASE p WHEN 4 THEN 'block' WHEN 3 THEN 'rate_limit' WHEN 2 THEN 'alert' WHEN 1 THEN 'log' END AS action FROM h")
def http_action(spark, sf):
    return pages(spark, sf).select("page_id", S.recommended_action(S.match_list(F.lower("url"), S.HTTP_PATTERNS)).alias("action"))


@register("H47_header_scan", "SELECT page_id, regexp_matches(lower(html), 'nikto|sqlmap|track') AS scanner, contains(lower(html), 'cookie') AS cookie FROM pages")
def header_scan(spark, sf):
    h = F.lower("html")
    return pages(spark, sf).select("page_id", h.rlike("nikto|sqlmap|track").alias("scanner"), h.contains("cookie").alias("cookie"))


@register("B39_suspicious_uri", "SELECT page_id, contains(url, '..') OR contains(url, 'page=1') OR contains(url, '/de/') AS suspicious FROM pages")
def suspicious_uri(spark, sf):
    return pages(spark, sf).select("page_id", S.any_contains(F.col("url"), ("..", "page=1", "/de/")).alias("suspicious"))


@register("B40_suspicious_agent", "SELECT page_id, contains(lower(html), 'nav') AND contains(lower(html), 'script') AS suspicious FROM pages")
def suspicious_agent(spark, sf):
    h = F.lower("html")
    return pages(spark, sf).select("page_id", (h.contains("nav") & h.contains("script")).alias("suspicious"))


@register("B41_inline_http", f"SELECT page_id, contains(url, '..') OR contains(lower(url), 'select') OR contains(lower(html), '<script') OR length({HOST}) > 100 AS alert FROM pages")
def inline_http(spark, sf):
    host = F.regexp_extract("url", r"^https?://([^/:?]+)", 1)
    return pages(spark, sf).select("page_id", (F.col("url").contains("..") | F.lower("url").contains("select") | F.lower("html").contains("<script") | (F.length(host) > 100)).alias("alert"))


@register("B44_http_alerts", "WITH a AS (SELECT page_id, unnest(list_filter([CASE WHEN contains(url, '..') THEN 'traversal' END, CASE WHEN regexp_matches(url, 'page=[0-9]') THEN 'scan' END, CASE WHEN length(html) > 4000 THEN 'anomaly' END], lambda x: x IS NOT NULL)) AS alert FROM pages) SELECT * FROM a")
def http_alerts(spark, sf):
    u = F.col("url")
    alerts = F.array(F.when(u.contains(".."), "traversal"), F.when(u.rlike("page=[0-9]"), "scan"), F.when(F.length("html") > 4000, "anomaly"))
    return pages(spark, sf).select("page_id", F.explode(F.filter(alerts, lambda x: x.isNotNull())).alias("alert"))


@register("B15_content_position", "SELECT doc_id, CAST(strpos(text, 'the ') AS INTEGER) AS first_at, CAST(strpos(substr(text, 11, 200), 'the ') AS INTEGER) AS within FROM documents")
def content_position(spark, sf):
    return docs(spark, sf).select("doc_id", F.instr("text", "the ").alias("first_at"), F.instr(F.substring("text", 11, 200), "the ").alias("within"))


@register("B16_nocase_find", "SELECT doc_id, CAST(strpos(lower(text), 'the') AS INTEGER) AS at FROM documents")
def nocase_find(spark, sf):
    return docs(spark, sf).select("doc_id", F.instr(F.lower("text"), "the").alias("at"))


@register("B17_multi_content", "WITH a AS (SELECT doc_id, text, strpos(text, 'on ') AS p FROM documents), b AS (SELECT *, CASE WHEN p > 0 THEN strpos(substr(text, p + 3), 'er ') ELSE 0 END AS q FROM a) SELECT doc_id FROM b WHERE p > 0 AND q > 0 AND strpos(text, 'xyzzy') = 0")
def multi_content(spark, sf):
    p = F.locate("on ", F.col("text"))
    a = docs(spark, sf).withColumn("p", p).filter("p > 0").withColumn("q", F.instr(F.substring(F.col("text"), F.col("p") + 3, F.length("text")), "er "))
    return a.filter((F.col("q") > 0) & ~F.col("text").contains("xyzzy")).select("doc_id")


@register("B19_pcre", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\bth[aeiou]+nt') AND NOT regexp_matches(text, '[0-9]{8}')")
def pcre(spark, sf):
    t = F.col("text")
    return docs(spark, sf).filter(t.rlike(r"(?i)\bth[aeiou]+nt") & ~t.rlike("[0-9]{8}")).select("doc_id")


@register("B18_sticky_buffer", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1) WHEN 1 THEN regexp_extract(url, '^https?://([^/:?]+)', 1) ELSE url END AS buffer FROM pages")
def sticky_buffer(spark, sf):
    k = F.col("page_id") % 3
    return pages(spark, sf).select("page_id", F.when(k == 0, F.regexp_extract("url", r"^https?://[^/]+(/[^?]*)", 1)).when(k == 1, F.regexp_extract("url", r"^https?://([^/:?]+)", 1)).otherwise(F.col("url")).alias("buffer"))


@register("B42_attachment", "SELECT page_id, regexp_extract(url, '([a-z]+)$', 1) IN ('exe', 'js', 'x', 'html') AS dangerous FROM pages")
def attachment(spark, sf):
    return pages(spark, sf).select("page_id", F.regexp_extract("url", "([a-z]+)$", 1).isin("exe", "js", "x", "html").alias("dangerous"))


@register("H25_dns_tunnel", f"WITH h AS (SELECT page_id, string_split({HOST}, '.') AS l FROM pages) SELECT page_id, len(l) > 7 OR len(list_filter(l, lambda x: length(x) > 63 OR (length(x) > 30 AND len(list_distinct(string_split(x, ''))) > 0.7 * length(x)))) > 0 AS tunnel FROM h")
def dns_tunnel(spark, sf):
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?]+)", 1))
    return pages(spark, sf).select("page_id", S.is_tunnel(host).alias("tunnel"))


ENT = """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?]+)', 1)) AS host FROM pages), m AS (SELECT page_id, host, array_to_string(list_slice(string_split(host, '.'), 1, len(string_split(host, '.')) - 1), '') AS main FROM h),
c AS (SELECT page_id, main, unnest(string_split(main, '')) AS ch FROM m WHERE main <> ''), n AS (SELECT page_id, main, ch, count(*) AS n FROM c GROUP BY 1, 2, 3), e AS (SELECT page_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM n GROUP BY 1)"""


@register("H28_entropy", f"{ENT} SELECT m.page_id, round(coalesce(e, 0), 6) AS entropy FROM m LEFT JOIN e USING (page_id)")
def entropy(spark, sf):
    parts = F.split(F.lower(F.regexp_extract("url", r"^https?://([^/:?]+)", 1)), r"\.")
    main = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "")
    return pages(spark, sf).select("page_id", F.round(S.char_entropy(main), 6).alias("entropy"))


@register("H26_dga", f"{ENT} SELECT m.page_id, length(main) >= 10 AND (e > 3.5 OR (e > 3.0 AND length(regexp_replace(main, '[^0-9]', '', 'g')) > 0.3 * length(main))) AS dga FROM m JOIN e USING (page_id)")
def dga(spark, sf):
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?]+)", 1))
    return pages(spark, sf).select("page_id", S.is_dga(host).alias("dga"))


@register("H27_suspicious_tld", f"SELECT page_id, regexp_extract({HOST}, '([^.]+)$', 1) IN ('tk', 'ml', 'ga', 'cf', 'xyz', 'top') AS suspicious FROM pages")
def suspicious_tld(spark, sf):
    return pages(spark, sf).select("page_id", F.regexp_extract(F.lower(F.regexp_extract("url", r"^https?://([^/:?]+)", 1)), r"([^.]+)$", 1).isin(*S.SUSPICIOUS_TLDS).alias("suspicious"))


@register("H31_typosquat", f"SELECT page_id, (levenshtein({HOST}, 'example.com') <= 6 AND {HOST} <> 'example.com') AS squat FROM pages")
def typosquat(spark, sf):
    host = F.lower(F.regexp_extract("url", r"^https?://([^/:?]+)", 1))
    return pages(spark, sf).select("page_id", ((F.levenshtein(host, F.lit("example.com")) <= 6) & (host != "example.com")).alias("squat"))


@register("H30_email_parse", "WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS e FROM documents) SELECT doc_id, e AS email, split_part(e, '@', 1) AS local, split_part(e, '@', 2) AS domain FROM m")
def email_parse(spark, sf):
    m = docs(spark, sf).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), 0)).alias("email"))
    return m.select("doc_id", "email", F.split_part("email", F.lit("@"), F.lit(1)).alias("local"), F.split_part("email", F.lit("@"), F.lit(2)).alias("domain"))


@register("H32_spam_subject", "SELECT conv_id, turn, regexp_matches(lower(substr(text, 1, 60)), 'free|win|urgent|the|der') AS spam FROM conversations")
def spam_subject(spark, sf):
    return T.table(spark, sf, "conversations").select("conv_id", "turn", F.lower(F.substring("text", 1, 60)).rlike("free|win|urgent|the|der").alias("spam"))


@register("H40_hassh", "SELECT page_id, md5(concat_ws(';', url, CAST(length(html) AS VARCHAR), 'none')) AS hassh FROM pages")
def hassh(spark, sf):
    return pages(spark, sf).select("page_id", F.md5(F.concat_ws(";", "url", F.length("html").cast("string"), F.lit("none")).cast("binary")).alias("hassh"))


@register("H41_ja3", f"WITH {D}, s AS (SELECT src, list_sort(list_distinct(list(port))) AS codes FROM det GROUP BY 1) SELECT src, md5('771,' || array_to_string(list_filter(codes, lambda c: (c & 3) <> 2), '-')) AS ja3 FROM s")
def ja3(spark, sf):
    s = T.detections(spark, sf).groupBy("src").agg(F.sort_array(F.collect_set("port")).alias("codes"))
    kept = F.filter("codes", lambda c: c.bitwiseAND(F.lit(3)) != 2)
    return s.select("src", F.md5(F.concat(F.lit("771,"), F.array_join(F.transform(kept, lambda x: x.cast("string")), "-")).cast("binary")).alias("ja3"))


@register("H42_grease", "SELECT p_partkey, (p_partkey * 257 & 3855) = 2570 AS grease FROM part")
def grease(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", ((F.col("p_partkey") * 257).bitwiseAND(F.lit(3855)) == 2570).alias("grease"))


@register("H39_weak_algorithms", "SELECT o_custkey, array_to_string(list_sort(list_intersect(list_distinct(list(o_orderpriority)), ['1-URGENT', '5-LOW'])), ',') AS weak FROM orders GROUP BY 1")
def weak_algorithms(spark, sf):
    s = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"))
    return s.select("o_custkey", F.array_join(F.sort_array(F.array_intersect("a", F.array(F.lit("1-URGENT"), F.lit("5-LOW")))), ",").alias("weak"))


@register("H50_request_parse", "SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1) AS path, regexp_extract(url, '[?&]page=([^&]*)', 1) AS page, regexp_extract(url, '[?&]ref=([^&]*)', 1) AS ref FROM pages")
def request_parse(spark, sf):
    q = lambda k: F.coalesce(F.parse_url("url", F.lit("QUERY"), F.lit(k)), F.lit(""))
    return pages(spark, sf).select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.regexp_extract("url", r"^https?://[^/]+(/[^?]*)", 1).alias("path"), q("page").alias("page"), q("ref").alias("ref"))


SAN = "text"
for _n, _p, _r in S.REDACTIONS:
    SAN = f"regexp_replace({SAN}, '{_p}', '{_r}', 'g')"


@register("H61_sanitise", "SELECT doc_id, md5(%s) AS clean, %s FROM documents" % (SAN, ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS n_{n}" for n, p, _ in S.REDACTIONS)))
def sanitise(spark, sf):
    r = S.redact(docs(spark, sf).select("doc_id", "text"), "text", "clean")
    return r.select("doc_id", F.md5(F.col("clean").cast("binary")).alias("clean"), *[f"n_{n}" for n, _, _ in S.REDACTIONS])


@register("H62_credentials", r"SELECT doc_id, regexp_matches(text, 'AKIA[0-9A-Z]{16}') OR regexp_matches(text, '(?i)bearer [a-z0-9._-]+') OR contains(text, 'PRIVATE KEY') AS has_secret FROM documents")
def credentials(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", (t.rlike("AKIA[0-9A-Z]{16}") | t.rlike("(?i)bearer [a-z0-9._-]+") | t.contains("PRIVATE KEY")).alias("has_secret"))


@register("H60_chunks", "SELECT doc_id, chunk, md5(substr(text, chunk * 400 + 1, 500)) AS piece FROM (SELECT doc_id, text, CAST(unnest(range(0, CAST(greatest(ceil((length(text) - 100) / 400), 1) AS BIGINT))) AS INTEGER) AS chunk FROM documents)")
def text_chunks(spark, sf):
    c = S.chunks(docs(spark, sf), "text", 500, 100)
    return c.select("doc_id", "chunk", F.md5(F.col("piece").cast("binary")).alias("piece"))


@register("H64_payload_dpi", r"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[0-9]{1,3}(\.[0-9]{1,3}){3}') THEN 'ip' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN regexp_matches(text, '!!') THEN 'noise' END], lambda x: x IS NOT NULL), ',') AS threats FROM documents")
def payload_dpi(spark, sf):
    t = F.col("text")
    found = F.array(F.when(t.rlike(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"), "ip"), F.when(t.contains("@"), "mail"), F.when(t.rlike("!!"), "noise"))
    return docs(spark, sf).select("doc_id", F.array_join(F.filter(found, lambda x: x.isNotNull()), ",").alias("threats"))


@register("H66_malware_family", "SELECT doc_id, CASE WHEN contains(lower(text), 'emotet') THEN 'emotet' WHEN contains(lower(text), 'trick') THEN 'trickbot' WHEN contains(lower(text), 'the') THEN 'generic' END AS family FROM documents")
def malware_family(spark, sf):
    t = F.lower("text")
    return docs(spark, sf).select("doc_id", F.when(t.contains("emotet"), "emotet").when(t.contains("trick"), "trickbot").when(t.contains("the"), "generic").alias("family"))


@register("H90_triage_priority", "SELECT conv_id, turn, CASE WHEN contains(upper(text), 'P1') OR contains(upper(text), 'CRITICAL') THEN 'P1' WHEN contains(upper(text), 'OF') THEN 'P2' WHEN contains(upper(text), 'UN') THEN 'P3' ELSE 'P4' END AS priority FROM conversations")
def triage_priority(spark, sf):
    t = F.upper("text")
    return T.table(spark, sf, "conversations").select("conv_id", "turn", F.when(t.contains("P1") | t.contains("CRITICAL"), "P1").when(t.contains("OF"), "P2").when(t.contains("UN"), "P3").otherwise("P4").alias("priority"))


@register("H91_mitre_ids", r"SELECT doc_id, array_to_string(regexp_extract_all(upper(text), 'T[0-9]{4}(\.[0-9]{3})?'), ',') AS ids, CAST(len(regexp_extract_all(text, '[0-9]{4}')) AS INTEGER) AS numbers FROM documents")
def mitre_ids(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(F.regexp_extract_all(F.upper("text"), F.lit(r"T[0-9]{4}(\.[0-9]{3})?"), 0), ",").alias("ids"), F.size(F.regexp_extract_all("text", F.lit("[0-9]{4}"), 0)).alias("numbers"))


@register("H92_context_format", "SELECT conv_id, string_agg('[' || role || '] ' || length(text), ' ' ORDER BY turn) AS context FROM conversations GROUP BY 1")
def context_format(spark, sf):
    c = T.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("["), "role", F.lit("] "), F.length("text").cast("string")).alias("s")))).alias("a"))
    return c.select("conv_id", F.array_join(F.transform("a", lambda x: x["s"]), " ").alias("context"))


@register("H97_attack_type", "SELECT doc_id, CASE WHEN contains(lower(text), 'scan') THEN 'scan' WHEN contains(lower(text), 'brute') THEN 'brute_force' WHEN contains(lower(text), 'est') THEN 'probe' ELSE 'unknown' END AS kind FROM documents")
def attack_type(spark, sf):
    t = F.lower("text")
    return docs(spark, sf).select("doc_id", F.when(t.contains("scan"), "scan").when(t.contains("brute"), "brute_force").when(t.contains("est"), "probe").otherwise("unknown").alias("kind"))


@register("H08_fuzzy_type", f"WITH {D} SELECT event_id, lower(event_type) = 'error' OR regexp_matches(event_type, 'click|view') AS same FROM det")
def fuzzy_type(spark, sf):
    t = F.col("event_type")
    return T.detections(spark, sf).select("event_id", ((F.lower(t) == "error") | t.rlike("click|view")).alias("same"))


@register("H09_type_substring", f"WITH {D} SELECT event_id, contains(event_type, 'err') OR contains(event_type, 'Sign') AS hit FROM det")
def type_substring(spark, sf):
    return T.detections(spark, sf).select("event_id", F.exists(F.array(F.lit("err"), F.lit("Sign")), lambda x: F.col("event_type").contains(x)).alias("hit"))


@register("H11_tactics", f"WITH {D} SELECT event_id, CASE event_type WHEN 'view' THEN 'Reconnaissance' WHEN 'click' THEN 'InitialAccess' WHEN 'signup' THEN 'Persistence' WHEN 'purchase' THEN 'Collection' WHEN 'error' THEN 'Impact' END AS tactic, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'signup' THEN 5 WHEN 'purchase' THEN 11 WHEN 'error' THEN 14 END AS tactic_order FROM det")
def tactics(spark, sf):
    from .correlate import TACTICS

    dim = spark.createDataFrame(TACTICS, "event_type string, tactic string, tactic_order int")
    return T.detections(spark, sf).join(F.broadcast(dim), "event_type").select("event_id", "tactic", "tactic_order")  # one row per event type


@register("A41_cef", f"WITH {D} SELECT event_id, 'CEF:0|spark|engine|1|100|' || event_type || '|' || severity || '|src=' || src || ' dpt=' || port AS line FROM det")
def cef(spark, sf):
    return T.detections(spark, sf).select("event_id", S.cef({"src": F.col("src"), "dpt": F.col("port").cast("string")}, F.col("event_type"), F.col("severity")).alias("line"))


@register("A42_leef", f"WITH {D} SELECT event_id, 'LEEF:2.0|spark|engine|1|' || event_type || chr(9) || 'src=' || src || chr(9) || 'sev=' || severity AS line FROM det")
def leef(spark, sf):
    return T.detections(spark, sf).select("event_id", F.concat_ws("\t", F.concat(F.lit("LEEF:2.0|spark|engine|1|"), "event_type"), F.concat(F.lit("src="), "src"), F.concat(F.lit("sev="), F.col("severity").cast("string"))).alias("line"))


@register("A43_syslog", f"WITH {D} SELECT event_id, '<' || (32 + severity) || '>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' engine ' || event_type AS line FROM det")
def syslog(spark, sf):
    return T.detections(spark, sf).select("event_id", F.concat(F.lit("<"), (F.lit(32) + F.col("severity")).cast("string"), F.lit(">1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" engine "), "event_type").alias("line"))


@register("A44_siem_json", f"""WITH {D} SELECT event_id, '{{"src":"' || src || '","type":"' || event_type || '","severity":' || severity || '}}' AS line FROM det""")
def siem_json(spark, sf):
    return T.detections(spark, sf).select("event_id", F.to_json(F.struct("src", F.col("event_type").alias("type"), "severity")).alias("line"))


@register("A45_cef_escape", r"SELECT page_id, replace(replace(url, '\', '\\'), '=', '\=') AS escaped FROM pages")
def cef_escape(spark, sf):
    return pages(spark, sf).select("page_id", F.replace(F.replace("url", F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\=")).alias("escaped"))
