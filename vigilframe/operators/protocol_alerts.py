"""Alerts from the state that a flow's messages leave: DNS, SSH, SMTP, SMB and TLS; spoofed sources, ICMP rates, access points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .watch import ADMIN_PIPES

# Endings of names that are often abused, and account names that brute force tries first.
SUSPICIOUS_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".top", ".xyz", ".loan", ".work", ".onion"]
PRIVILEGED = ["root", "admin", "administrator"]
# Networks that no source may have, and those that a configuration may allow.
BOGONS = ["0.0.0.0/8", "192.0.0.0/24", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "255.255.255.255/32"]
ALLOWABLE = {"private": ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"], "link_local": ["169.254.0.0/16"], "loopback": ["127.0.0.0/8"]}
# ICMP types with a rate of their own, and the seconds of the window.
ICMP_TYPES, ICMP_WINDOW = {"redirect": 5, "quench": 4, "unreachable": 3, "ttl_exceeded": 11}, 10

ALERT = "struct<severity: string, message: string>"


def _alert(severity: str, *message) -> Column:
    parts = [F.lit(m) if isinstance(m, str) else m.cast("string") for m in message]
    return F.struct(F.lit(severity).alias("severity"), F.concat(*parts).alias("message"))


def _list(*alerts: Column) -> Column:
    return F.array_compact(F.array(*[a.cast(ALERT) for a in alerts]))


def _each(values: Column, make) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), make).cast(f"array<{ALERT}>")


def dns_tunnel(name: Column, kind: Column) -> Column:
    """A label over 63 characters, one over 30 of which more than 0.7 differ, over 7 labels, or a TXT or ANY query over 100 characters."""
    labels = F.split(name, r"\.")
    mixed = lambda x: (F.length(x) > 63) | ((F.length(x) > 30) & (F.size(F.filter(F.array_distinct(F.split(x, "")), lambda c: c != "")) / F.length(x) > 0.7))
    return F.exists(labels, mixed) | (F.size(labels) > 7) | (kind.isin("TXT", "ANY") & (F.length(name) > 100))


def dns_state(messages: DataFrame, flow: list[str]) -> DataFrame:
    """Messages (flow, response, rcode, name, kind) of each flow as queries, nxdomain, tunnel and the suspicious names in order of the name."""
    query = ~F.col("response")
    bad = reduce(lambda a, b: a | b, [F.col("name").endswith(t) for t in SUSPICIOUS_TLDS])
    return messages.groupBy(*flow).agg(
        F.count_if(query).alias("queries"), F.count_if(F.col("response") & (F.col("rcode") == 3)).alias("nxdomain"), F.coalesce(F.bool_or(query & dns_tunnel(F.col("name"), F.col("kind"))), F.lit(False)).alias("tunnel"),
        F.count_if(query & bad).alias("suspicious"),
    )


def dns_alerts(s: DataFrame) -> Column:
    """Tunnelling, over half of 10 or more queries without a domain, one alert for all names with a suspicious ending, over 100 queries."""
    q, nx = F.col("queries"), F.col("nxdomain")
    return _list(
        F.when(F.col("tunnel"), _alert("High", "DNS tunneling detected - potential data exfiltration")),
        F.when((q >= 10) & (nx / F.greatest(q, F.lit(1)) > 0.5), _alert("High", "Potential DGA activity - ", nx, " NXDOMAIN out of ", q, " queries")),
        F.when(F.col("suspicious") > 0, _alert("Medium", "Queries to suspicious TLD: ", F.col("suspicious"))), F.when(q > 100, _alert("Low", "High DNS query rate: ", q, " queries")),
    )


def ssh_alerts(s: DataFrame) -> Column:
    """From protocol (1 or 2), bad_hassh and bad_software (null where none), weak (algorithms), software, cves, failures and username."""
    c = F.col
    joined = lambda x: F.array_join(x, ", ")
    return _list(
        F.when(c("protocol") == 1, _alert("Critical", "Deprecated SSH-1 protocol detected")), F.when(c("bad_hassh").isNotNull(), _alert("High", "Suspicious SSH HASSH fingerprint: ", c("bad_hassh"))),
        F.when(c("bad_software").isNotNull(), _alert("Medium", "Suspicious SSH client software: ", c("bad_software"))), F.when(F.size("weak") > 0, _alert("Medium", "Weak SSH algorithms detected: ", joined("weak"))),
        F.when(F.size("cves") > 0, _alert("High", "Vulnerable SSH version: ", c("software"), " (CVEs: ", joined("cves"), ")")), F.when(c("failures") >= 3, _alert("High", "SSH brute force attempt: ", c("failures"), " failures")),
        F.when(c("username").isin(PRIVILEGED), _alert("Medium", "SSH privileged account login attempt: ", c("username"))),
    )


def smtp_alerts(s: DataFrame) -> Column:
    """From attachments, spam and phishing (arrays), spoofed, failures, transactions, recipients, username (null: none sent) and tls."""
    c = F.col
    joined = lambda x: F.array_join(x, ", ")
    return _list(
        F.when(F.size("attachments") > 0, _alert("High", "Dangerous email attachment: ", joined("attachments"))), F.when(F.size("spam") > 0, _alert("Medium", "Spam indicators detected: ", joined("spam"))),
        F.when(F.size("phishing") > 0, _alert("High", "Phishing indicators detected: ", joined("phishing"))), F.when(c("spoofed"), _alert("High", "Email spoofing detected (SPF/DKIM/DMARC failure)")),
        F.when(c("failures") >= 3, _alert("High", "SMTP authentication brute force: ", c("failures"), " failures")),
        F.when((c("transactions") >= 10) | (c("recipients") >= 50), _alert("Medium", "Mass mailer detected: ", c("transactions"), " transactions, ", c("recipients"), " recipients")),
        F.when(c("username").isNotNull() & ~c("tls"), _alert("Medium", "SMTP authentication without TLS - credentials may be exposed")),
    )


def smb_alerts(s: DataFrame) -> Column:
    """From smb1, failures, lateral, ransomware, suspicious (a count), and the open shares and pipes (arrays of names)."""
    c = F.col
    share = lambda x: F.when(F.lower(x).endswith("$") & F.lower(x).contains("admin$"), _alert("High", "Admin share access: ", x)).when(F.lower(x).endswith("$") & (F.lower(x).contains("c$") | F.lower(x).contains("d$")), _alert("Medium", "Hidden drive share access: ", x))
    pipe = lambda x: F.when(reduce(lambda a, b: a | b, [F.lower(x).contains(f"\\pipe\\{p}") for p in ADMIN_PIPES]), _alert("Medium", "Suspicious named pipe access: ", x))
    own = _list(
        F.when(c("smb1"), _alert("Medium", "SMB1 protocol detected - legacy and vulnerable")), F.when(c("failures") >= 5, _alert("High", "SMB authentication brute force detected - ", c("failures"), " failures")),
        F.when(c("lateral"), _alert("High", "Potential lateral movement via SMB detected")), F.when(c("ransomware"), _alert("Critical", "Potential ransomware activity - ", c("suspicious"), " suspicious files accessed")),
    )
    return F.concat(own, F.array_compact(_each(c("shares"), share)), F.array_compact(_each(c("pipes"), pipe)))


def tls_alerts(s: DataFrame) -> Column:
    """From bad_ja3 (null where the fingerprint is not listed) and version, a number (0x0303 is TLS 1.2)."""
    return _list(F.when(F.col("bad_ja3").isNotNull(), _alert("High", "Suspicious JA3 fingerprint detected: ", F.col("bad_ja3"))), F.when(F.col("version") < 0x0303, _alert("Medium", "Deprecated TLS version: ", F.col("version"))))


def inside(number: Column, networks: list[str]) -> Column:
    """Whether an address as a number is in one of a few fixed networks."""
    tests = []
    for net in networks:
        address, bits = net.split("/")
        low = sum(int(p) << (24 - 8 * i) for i, p in enumerate(address.split(".")))
        tests.append(number.between(low, low + (1 << (32 - int(bits))) - 1))
    return reduce(lambda a, b: a | b, tests)


def spoofed_source(number: Column, allow: tuple[str, ...] = ("private", "link_local"), trusted: list[str] | None = None) -> Column:
    """`bogon` for a source in a network that is never one or is not allowed here, `martian` for others from 240.0.0.0 on; null else. Trusted networks are neither."""
    bad = [n for n in BOGONS] + [n for kind, nets in ALLOWABLE.items() if kind not in allow for n in nets]
    found = F.when(inside(number, bad), "bogon").when((number >= 240 << 24) | (number == 0), "martian")
    return F.when(~inside(number, trusted), found) if trusted else found


def land_attack(p: DataFrame) -> Column:
    """Equal addresses and equal ports other than 0."""
    return (F.col("src_num") == F.col("dst_num")) & (F.col("src_port") == F.col("dst_port")) & (F.col("src_port") != 0)


def spoof_features(packets: DataFrame, by: list[str], allow: tuple[str, ...] = ("private", "link_local")) -> DataFrame:
    """bogon and martian shares of packets, ttl_anomaly (always 0) and land, 1 where there was such an attack."""
    kind = spoofed_source(F.col("src_num"), allow)
    share = lambda k: F.count_if(kind == k) / F.count(F.lit(1))
    return packets.groupBy(*by).agg(share("bogon").alias("bogon"), share("martian").alias("martian"), F.lit(0.0).alias("ttl_anomaly"), F.max(land_attack(packets).cast("double")).alias("land"))


def icmp_rates(messages: DataFrame, keys: list[str], second_us: int = 1_000_000) -> DataFrame:
    """messages(keys, us, event_id, type) with the rates a second of the four types in the present window, this message included.

    A window begins with its first message and ends with the first one more than ICMP_WINDOW seconds later, which begins
    the next. The rate's time is at least a tenth of a second.
    """
    from .stateful import AnchoredWindow, fold

    order = ("us", "event_id")
    rows = fold(messages, keys, lambda: AnchoredWindow(ICMP_WINDOW * second_us), "__window", "int", order)
    w = Window.partitionBy(*keys, "__window").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seconds = F.greatest((F.col("us") - F.min("us").over(w)) / second_us, F.lit(0.1))
    return rows.select(*messages.columns, *[(F.sum((F.col("type") == t).cast("long")).over(w) / seconds).alias(name) for name, t in ICMP_TYPES.items()])


def access_points(beacons: DataFrame, trusted: DataFrame, end_us: Column, timeout_us: int = 300_000_000) -> DataFrame:
    """State of the access points that are active at end_us: bssid, ssid, channel, rsn, beacons, signal, is_known, evil_twin.

    beacons(us, event_id, bssid, ssid, channel, rsn, signal); trusted(bssid). A point that is silent for the timeout is
    forgotten and begins anew. The first beacon names it; channel and rsn are the last ones given, signal is the mean of
    the last ten, towards zero. evil_twin: a trusted and an untrusted active point have sent the same name.
    """
    w = Window.partitionBy("bssid").orderBy("us", "event_id")
    gap = F.when(F.col("us") - F.lag("us").over(w) >= timeout_us, 1).otherwise(0)
    rows = beacons.withColumn("__gap", gap).withColumn("__run", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"__last": F.max("__run").over(Window.partitionBy("bssid")), "__at": F.struct("us", "event_id")}).filter("__run = __last")
    heard = Window.partitionBy("bssid", F.col("signal").isNull()).orderBy(F.desc("us"), F.desc("event_id"))
    rows = rows.withColumn("__recent", F.row_number().over(heard) <= 10)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__at")))
    signal = F.when(F.col("__recent"), F.col("signal"))
    points = rows.groupBy("bssid").agg(F.min_by("ssid", "__at").alias("ssid"), F.coalesce(last("channel"), F.lit(0)).alias("channel"), last("rsn").alias("rsn"), F.count(F.lit(1)).alias("beacons"), F.sum(signal).alias("__s"), F.count(signal).alias("__n"), F.max("us").alias("__seen"))
    active = points.filter(end_us - F.col("__seen") < timeout_us)
    mean = F.when(F.col("__n") > 0, (F.col("__s") / F.col("__n")).cast("int"))
    active = active.join(trusted.select(F.col("bssid").alias("__t")).distinct(), F.col("bssid") == F.col("__t"), "left").withColumns({"signal": mean, "is_known": F.col("__t").isNotNull()})
    names = rows.select("bssid", F.col("ssid").alias("__name")).distinct().join(active.select(F.col("bssid").alias("__b"), "is_known"), F.col("bssid") == F.col("__b"))
    twins = names.groupBy("__name").agg((F.bool_or("is_known") & ~F.bool_and("is_known")).alias("__twin")).filter("__twin").select("__name")
    marked = names.join(twins, "__name", "left_semi").select(F.col("bssid").alias("__m")).distinct()
    out = active.join(marked, F.col("bssid") == F.col("__m"), "left")
    return out.select("bssid", "ssid", "channel", "rsn", "beacons", "signal", "is_known", F.col("__m").isNotNull().alias("evil_twin"))


# What makes an address or a client of HTTP suspicious, in the order in which they are looked for.
URI_PATTERNS = [
    "../", "..\\", "' OR", "' AND", "UNION SELECT", "1=1", "; ls", "| cat", "$(", "<!ENTITY", "localhost", "127.0.0.1", "169.254.",
    "/wp-admin", "/phpmyadmin", "/admin", "/.env", "/.git", "/actuator", "/solr", "/console", "/manager",
]
AGENT_PATTERNS = ["sqlmap", "nikto", "nmap", "masscan", "burp", "curl", "wget", "python-requests", "go-http", "scanner", "bot", "crawl"]


def uri_pattern(uri: Column) -> Column:
    """The first of URI_PATTERNS that an address contains, whatever its case; null without one."""
    low = F.lower(uri)
    out = F.lit(None).cast("string")
    for p in reversed(URI_PATTERNS):
        out = F.when(low.contains(p.lower()), F.lit(p)).otherwise(out)
    return out


def suspicious_agent(agent: Column) -> Column:
    low = F.lower(agent)
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(p) for p in AGENT_PATTERNS]), F.lit(False))


def http_state(messages: DataFrame, flow: list[str], order: list[str]) -> DataFrame:
    """Messages (flow, order, uri, agent, status) of each flow as traversal, injection, bad_agent (the last agent where any was suspicious), responses and errors.

    A request has a uri, a response a status. Only the first pattern of an address counts: one with `..` is traversal, one
    with a quote, UNION or 1=1 injection.
    """
    pattern = uri_pattern(F.col("uri"))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    last = F.max_by("agent", F.when(F.col("agent").isNotNull(), F.struct(*order)))
    s = messages.groupBy(*flow).agg(
        any_of(pattern.contains("..")).alias("traversal"), any_of(pattern.contains("'") | pattern.contains("UNION") | pattern.contains("1=1")).alias("injection"), any_of(suspicious_agent(F.col("agent"))).alias("__bad"),
        last.alias("__agent"), F.count("status").alias("responses"), F.count_if(F.col("status") >= 400).alias("errors"),
    )
    return s.withColumn("bad_agent", F.when(F.col("__bad"), F.col("__agent"))).drop("__bad", "__agent")


def tenths(x: Column) -> Column:
    """A double of 1 to 128 with one decimal as C's printf has it: the exact binary value decides, and an exact tie goes to the even digit."""
    n, one = (x * 2.0**52).cast("long") * 10, 1 << 52  # exact: a power of two loses no bits, and 1280 << 52 is below 1 << 63
    whole, rest = F.shiftright(n, 52), n.bitwiseAND(F.lit(one - 1))
    up = (rest > one // 2) | ((rest == one // 2) & (whole % 2 == 1))
    t = whole + up.cast("long")
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def http_alerts(s: DataFrame) -> Column:
    """Traversal, injection, a suspicious agent, and more than 10 errors that are over half of the responses."""
    share = F.col("errors") * 100 / F.greatest(F.col("responses"), F.lit(1))
    return _list(
        F.when(F.col("traversal"), _alert("High", "HTTP path traversal attempt detected")), F.when(F.col("injection"), _alert("High", "HTTP SQL injection attempt detected")),
        F.when(F.col("bad_agent").isNotNull(), _alert("Medium", "Suspicious HTTP User-Agent detected: ", F.col("bad_agent"))), F.when((F.col("errors") > 10) & (share > 50), _alert("Low", "High HTTP error rate: ", tenths(share), "%")),
    )
