"""Text operators as column expressions: log lines, HTTP scans, DNS and mail heuristics, sanitising, chunking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity scores of HTTP detections, and their actions by priority.
SEVERITY_SCORE = {"info": 0, "low": 1, "medium": 5, "high": 10, "critical": 20}
ACTION_PRIORITY = {"log": 1, "alert": 2, "rate_limit": 3, "block": 4}

#: A small pattern list (category, severity, action, RE2- and Java-compatible pattern).
HTTP_PATTERNS = [
    ("sqli", "critical", "block", r"(union\s+select|select\s.+\sfrom|or\s+1=1)"),
    ("traversal", "high", "block", r"(\.\./|%2e%2e)"),
    ("xss", "high", "alert", r"(<script|javascript:|onerror=)"),
    ("paging_probe", "low", "log", r"[?&]page=[0-9]+"),
    ("referral", "info", "log", r"[?&]ref="),
    ("scanner_path", "medium", "rate_limit", r"/(admin|wp-login|fr|de)/"),
]

#: Top-level domains often used for malware, and brands that typosquatters imitate.
SUSPICIOUS_TLDS = ("tk", "ml", "ga", "cf", "xyz", "top")
BRANDS = ("example.com", "google.com", "paypal.com")


def any_contains(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def match_list(text: Column, patterns: list[tuple[str, str, str, str]]) -> Column:
    """array<struct(category, severity, action, score)> of the patterns found in a text, in list order."""
    hits = [F.when(text.rlike(p), F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(a).alias("action"), F.lit(SEVERITY_SCORE[s]).alias("score"), F.lit(ACTION_PRIORITY[a]).alias("priority"))) for c, s, a, p in patterns]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


#: Actions of pattern files under this library's names.
FILE_ACTIONS = {"Drop": "block", "Block": "block", "RateLimit": "rate_limit", "Alert": "alert", "Log": "log"}


def pattern_list(table: DataFrame) -> list[tuple[str, str, str, str]]:
    """A table of categories as match_list takes it: literals and expressions of a category are one alternation, case ignored.

    The table is configuration of some hundred patterns; the driver reads it whole, by category.
    """
    out = []
    for r in sorted(table.collect(), key=lambda r: r["category"]):
        parts = [rf"\Q{p.lower()}\E" for p in r["patterns"]] + [f"(?:{p})" for p in r["regex"]]
        if parts:
            out.append((r["category"], r["severity"], FILE_ACTIONS.get(r["action"], "log"), "(?i)" + "|".join(parts)))
    return out


def threat_score(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda s, x: s + x["score"])


def recommended_action(hits: Column) -> Column:
    """The action of the highest priority; null without a hit."""
    return F.array_max(F.transform(hits, lambda x: F.struct(x["priority"].alias("p"), x["action"].alias("a"))))["a"]


def char_entropy(s: Column) -> Column:
    """Shannon entropy in bits of a short string's characters; 0 for an empty one."""
    n = F.length(s)
    chars = F.regexp_extract_all(s, F.lit("(?s)(.)"), 1)
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.size(F.filter(chars, lambda x: x == c)) * F.log2(F.size(F.filter(chars, lambda x: x == c))))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def is_dga(host: Column) -> Column:
    """Long, high-entropy names: at least 10 characters before the top-level domain, and above 3.5 bits or above 3.0 with over 30 % digits."""
    parts = F.split(F.lower(host), r"\.")
    main = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "")
    e, digits = char_entropy(main), F.length(F.regexp_replace(main, "[^0-9]", ""))
    return (F.size(parts) >= 2) & (F.length(main) >= 10) & ((e > 3.5) | ((e > 3.0) & (digits > 0.3 * F.length(main))))


def is_tunnel(host: Column) -> Column:
    """Labels over 63 characters, varied labels over 30, or more than 7 labels."""
    labels = F.split(host, r"\.")
    varied = lambda x: F.size(F.array_distinct(F.regexp_extract_all(x, F.lit("(?s)(.)"), 1))) > 0.7 * F.length(x)
    return (F.size(labels) > 7) | F.exists(labels, lambda x: (F.length(x) > 63) | ((F.length(x) > 30) & varied(x)))


def typosquat(host: Column, distance: int = 2) -> Column:
    """Near a known brand, but not it."""
    return reduce(lambda a, b: a | b, [(F.levenshtein(host, F.lit(b)) <= distance) & (host != b) for b in BRANDS])


#: What to redact, in order (name, pattern, replacement).
REDACTIONS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]"),
    ("ip", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[IP]"),
    ("bearer", r"(?i)bearer [a-z0-9._-]+", "[TOKEN]"),
    ("aws", r"AKIA[0-9A-Z]{16}", "[AWS_KEY]"),
    ("api_key", r"(?i)(api[_-]?key|password)[=:] ?[^ ]+", "[CREDENTIAL]"),
]


def sanitize(text: Column) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[1], r[2]), REDACTIONS, text)


#: What a text must hold before a pattern of REDACTIONS can match at all; cheap beside the pattern itself.
NEEDS = {
    "email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "bearer": lambda t: t.rlike("[bB][eE][aA][rR][eE][rR] "),
    "aws": lambda t: t.contains("AKIA"), "api_key": lambda t: t.rlike("[aA][pP][iI]|[pP][aA][sS][sS][wW]"),
}


def redact(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`, the sanitized text, and n_<name>, how often each pattern matches the text as it was.

    A pattern runs only over texts that hold what it needs; no replacement adds that, so the text as it was decides.
    Each step is a projection of its own, so none is computed twice.
    """
    for name, _, _ in REDACTIONS:
        df = df.withColumn(f"__has_{name}", NEEDS[name](F.col(text)))
    df = df.withColumns({f"n_{n}": F.when(F.col(f"__has_{n}"), F.regexp_count(F.col(text), F.lit(p)).cast("long")).when(F.col(text).isNotNull(), F.lit(0).cast("long")) for n, p, _ in REDACTIONS})
    df = df.withColumn(out, F.col(text))
    for name, pattern, by in REDACTIONS:
        df = df.withColumn(out, F.when(F.col(f"__has_{name}"), F.regexp_replace(out, pattern, by)).otherwise(F.col(out)))
    return df.drop(*[f"__has_{n}" for n, _, _ in REDACTIONS])


def redaction_counts(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)).cast("long").alias(f"n_{n}") for n, p, _ in REDACTIONS]


def chunks(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Overlapping pieces of each text with their number. It stops once a piece reaches the end of the text."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step) - 1, F.lit(0)).cast("int")
    return df.withColumn("chunk", F.explode(F.sequence(F.lit(0), last))).withColumn("piece", F.substring(F.col(text), F.col("chunk") * step + 1, F.lit(size)))


#: Patterns of service logs (service, event type, pattern with the address as group 1).
LOG_PATTERNS = [
    ("ssh", "failed_password", r"Failed password for (?:invalid user )?\S+ from ([0-9.]+) port \d+"),
    ("ssh", "invalid_user", r"Invalid user \S+ from ([0-9.]+)"),
    ("ssh", "max_attempts", r"maximum authentication attempts exceeded for \S+ from ([0-9.]+)"),
    ("ssh", "accepted", r"Accepted \S+ for \S+ from ([0-9.]+)"),
    ("postfix", "sasl_failure", r"\[([0-9.]+)\]: SASL \S+ authentication failed"),
    ("postfix", "relay_denied", r"RCPT from \S*\[([0-9.]+)\]: .*Relay access denied"),
    ("nginx_error", "forbidden", r"access forbidden by rule, client: ([0-9.]+)"),
    ("nginx_error", "limit", r"limiting requests, .*client: ([0-9.]+)"),
]


def match_log(line: Column) -> Column:
    """struct(service, event_type, ip) of the first pattern that matches; null where none does."""
    return F.coalesce(*[F.when(F.regexp_extract(line, p, 1) != "", F.struct(F.lit(s).alias("service"), F.lit(e).alias("event_type"), F.regexp_extract(line, p, 1).alias("ip"))) for s, e, p in LOG_PATTERNS])


ACCESS = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) [^"]*" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"'


def access_log(line: Column) -> Column:
    """Fields of a combined-format access line and what its request looks like."""
    g = lambda i: F.regexp_extract(line, ACCESS, i)
    url = F.lower(g(4))
    kind = (
        F.when(url.rlike(r"union(\+|%20| )select|or(\+|%20| )1=1"), "sql_injection").when(url.rlike(r"\.\./|%2e%2e"), "path_traversal").when(url.rlike(r"<script|%3cscript"), "xss")
        .when(url.rlike(r"(;|%3b|\|)(cat|ls|wget|curl)"), "command_injection").when(F.lower(g(8)).rlike(r"sqlmap|nikto|nmap|masscan"), "scanner").when(url.rlike(r"/\.env|/\.git|/etc/passwd"), "sensitive_file").when(url.rlike(r"wp-login|xmlrpc"), "cms_probe")
    )
    return F.when(g(1) != "", F.struct(g(1).alias("ip"), g(3).alias("method"), g(4).alias("url"), g(5).cast("int").alias("status"), g(8).alias("agent"), kind.alias("kind")))


def syslog_time(line: Column, year: int) -> Column:
    """Syslog lines carry no year: the caller's is assumed."""
    stamp = F.regexp_replace(F.regexp_extract(line, r"^([A-Z][a-z]{2} +\d+ \d\d:\d\d:\d\d)", 1), " +", " ")
    return F.try_to_timestamp(F.concat(F.lit(f"{year} "), stamp), F.lit("yyyy MMM d HH:mm:ss"))


def real_client(forwarded: Column, proxies: Column) -> Column:
    """First address of X-Forwarded-For that is not a proxy."""
    parts = F.transform(F.split(forwarded, ","), lambda x: F.trim(x))
    return F.try_element_at(F.filter(parts, lambda x: (x != "") & ~F.array_contains(proxies, x)), F.lit(1))


def cef(fields: dict[str, Column], name: Column, severity: Column) -> Column:
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\=")), F.lit("\n"), F.lit("\\n"))
    ext = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), esc(v)) for k, v in fields.items()])
    return F.concat(F.lit("CEF:0|spark|engine|1|100|"), name, F.lit("|"), severity.cast("string"), F.lit("|"), ext)
