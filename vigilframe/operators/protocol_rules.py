"""Protocol rules over parsed fields: TLS, SSH, SMTP and DNS checks, severities and stages. All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of weak cipher suites, both ends included.
WEAK_CIPHERS = [(0x0000, 0x000A), (0x0014, 0x001E), (0x0024, 0x0027), (0x002E, 0x0032), (0x0060, 0x0066), (0x0084, 0x009F), (0xC002, 0xC006), (0xC010, 0xC012)]
# Severity of each kind of log event; other kinds are 1.
LOG_SEVERITY = {
    9: ["SqlInjection", "CommandInjection", "WebShellAccess"], 8: ["PathTraversal", "XssAttempt"], 7: ["MaxAuthAttempts", "RateLimitExceeded"],
    5: ["FailedPassword", "InvalidUser", "SmtpAuthFailure"], 4: ["ScannerDetected", "SensitiveFileProbe", "CmsProbe", "BadProtocol", "BannerExchange"],
    3: ["ConnectionClosedPreauth", "ConnectionReset", "PamAuthFailure", "ErrorBurst"], 2: ["RelayDenied", "SpamDetected"], 0: ["Normal"],
}
SEVERITIES = ["Info", "Low", "Medium", "High", "Critical"]
# What a label contains, in order, and the threat it names; "but" must be absent.
LABELS = [
    (("syn_flood", "synflood"), None, "SynFlood"), (("udp_flood", "udpflood"), None, "UdpFlood"), (("icmp_flood", "icmpflood"), None, "IcmpFlood"),
    (("connection_exhaustion", "exhaustion"), None, "ConnectionExhaustion"), (("syn",), "flood", "PortScan:TcpSyn"), (("connect",), None, "PortScan:TcpConnect"),
    (("fin",), None, "PortScan:TcpFin"), (("xmas",), None, "PortScan:TcpXmas"), (("null",), None, "PortScan:TcpNull"), (("udp",), "flood", "PortScan:Udp"),
    (("brute", "auth"), None, "BruteForce"), (("ping", "sweep"), None, "PingSweep"), (("amplif",), None, "Amplification"),
]
OS_NAMES = [("ubuntu", "Ubuntu"), ("debian", "Debian"), ("rhel", "RHEL"), ("redhat", "RHEL"), ("centos", "CentOS"), ("freebsd", "FreeBSD")]


def first_case(cases: list[tuple[Column, str]]) -> Column:
    """The value of the first condition that holds, else null."""
    out = F.lit(None).cast("string")
    for test, value in reversed(cases):
        out = F.when(test, F.lit(value)).otherwise(out)
    return out


def found(*detections: Column) -> Column:
    """An array of the detections that are not null."""
    return F.array_compact(F.array(*detections))


def weak_cipher(cipher: Column) -> Column:
    return reduce(lambda a, b: a | b, [cipher.between(lo, hi) for lo, hi in WEAK_CIPHERS])


def client_hello(ciphers: Column, versions: Column, ja3: Column, bad_ja3: list[str]) -> Column:
    """Detections in a ClientHello: a weak cipher (once), only versions below TLS 1.2, a known fingerprint."""
    return found(
        F.when(F.exists(ciphers, weak_cipher), "TlsWeakCipher"),
        F.when((F.size(versions) > 0) & ~F.exists(versions, lambda v: v >= 0x0303), "TlsDowngrade"),
        F.when(ja3.isin(bad_ja3), "TlsKnownMalwareJa3"),
    )


def server_hello(cipher: Column, version: Column) -> Column:
    return found(F.when(weak_cipher(cipher), "TlsWeakCipher"), F.when(version < 0x0303, "TlsDowngrade"))


def certificate(subject: Column, issuer: Column, not_after: Column) -> Column:
    return found(F.when(subject == issuer, "TlsSelfSigned"), F.when(not_after.contains("1970") | not_after.contains("expired"), "TlsExpiredCert"))


def tls_probe(n_ciphers: Column, n_extensions: Column, version: Column, versions: Column) -> Column:
    """Whether a ClientHello looks like a scanner's: few ciphers or extensions, or an old version without a version list."""
    return (n_ciphers < 5) | (n_extensions < 3) | ((version < 0x0303) & (F.size(versions) == 0))


def ssh_version(line: Column) -> Column:
    """Struct (protocol, software, comments, os) of a version line `SSH-protocol-software comments`; null for any other line."""
    part = lambda k: F.regexp_extract(line, r"(?s)^SSH-(1\.0|1\.5|1\.99|2\.0)-([^ ]*)(?: (.*))?$", k)
    comments = F.when(F.instr(line, " ") > 0, part(3))
    os = first_case([(F.lower(comments).contains(word), name) for word, name in OS_NAMES])
    return F.when(part(1) != "", F.struct(F.when(part(1) == "2.0", 2).otherwise(1).alias("protocol"), part(2).alias("software"), comments.alias("comments"), os.alias("os")))


def domain_of(address: Column) -> Column:
    """Lower-cased domain of `name <local@domain>` or `local@domain`; null without one."""
    d = F.lower(F.regexp_extract(address, r"[^\s<>@]+@([^\s<>@]+)", 1))
    return F.when(d != "", d)


def mail_spam(subject: Column, recipients: Column, patterns: list[str]) -> Column:
    """A spam phrase in the subject, or more than 50 recipients."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.lower(subject).contains(p) for p in patterns]), F.lit(False)) | (recipients > 50)


def mail_phishing(subject: Column, header_from: Column, envelope_from: Column, patterns: list[str], suspicious: Column) -> Column:
    """A phishing phrase in the subject, header and envelope domains that differ, or a suspicious sender domain."""
    phrase = F.coalesce(reduce(lambda a, b: a | b, [F.lower(subject).contains(p) for p in patterns]), F.lit(False))
    return phrase | F.coalesce(domain_of(header_from) != domain_of(envelope_from), F.lit(False)) | F.coalesce(suspicious, F.lit(False))


def mail_header_anomaly(header_from: Column, date: Column, received: Column) -> Column:
    """From or Date missing, or more than 20 Received headers."""
    return header_from.isNull() | date.isNull() | (received > 20)


def dns_attacks(tunnelling: Column, generated: Column, is_response: Column, answers: Column, all_records: Column) -> Column:
    """Detections in a DNS message; a response with an answer and more than 10 records in all amplifies."""
    return found(F.when(tunnelling, "DnsTunneling"), F.when(generated, "DnsDga"), F.when(is_response & (answers > 0) & (all_records > 10), "DnsAmplification"))


def log_severity(kind: Column) -> Column:
    """0 to 9."""
    out = F.lit(1)
    for score, kinds in LOG_SEVERITY.items():
        out = F.when(kind.isin(kinds), score).otherwise(out)
    return out


def priority_severity(priority: Column) -> Column:
    return F.when(priority == 1, "Critical").when(priority == 2, "High").when(priority == 3, "Medium").otherwise("Low")


def elevated(severity: Column) -> Column:
    """One level up; the highest stays."""
    up = F.create_map(*[F.lit(x) for a, b in zip(SEVERITIES, [*SEVERITIES[1:], SEVERITIES[-1]], strict=True) for x in (a, b)])
    return up[severity]


def label_threat(label: Column) -> Column:
    """The threat that a label names; null where no rule knows it."""
    low = F.lower(label)
    cases = []
    for words, but, threat in LABELS:
        test = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        cases.append((test & ~low.contains(but) if but else test, threat))
    return first_case(cases)


def detect_protocol(payload: Column, port: Column, by_port: Column) -> Column:
    """Application protocol from the first bytes of a payload (binary), else by port; Unknown for an empty one."""
    text = payload.cast("string")
    hexed = F.hex(F.substring(payload, 1, 3))
    http = text.rlike(r"^(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|CONNECT|TRACE) |^HTTP/")
    dns = (port == 53) & (F.octet_length(payload) >= 12)
    tls = hexed.rlike("^1[4-7]03")
    return F.when(F.octet_length(payload) == 0, "Unknown").when(http, "Http").when(dns, "Dns").when(tls, "Https").when(text.startswith("SSH-"), "Ssh").otherwise(by_port)


def stages_enabled(config: dict[str, bool], stages: list[tuple[str, object]]) -> list[tuple[str, object]]:
    """The (name, function) stages that a configuration leaves on; unknown names are off. Off stages never enter the plan."""
    return [(name, f) for name, f in stages if config.get(name, False)]


def audit_record(packet: Column, stages: Column, events: Column, verdict: Column, microseconds: Column) -> Column:
    """One audit record: what a packet was, what each stage said, the events found, the verdict and the time it took."""
    return F.struct(
        packet.alias("packet_id"), verdict.alias("verdict"), F.size(stages).alias("stages_run"), F.coalesce(F.array_max(F.transform(events, lambda e: e["severity"])), F.lit(0)).alias("max_severity"),
        F.transform(events, lambda e: e["type"]).alias("event_types"), F.coalesce(microseconds, F.lit(0)).alias("processing_us"),
    )
