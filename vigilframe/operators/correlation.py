"""Correlation of typed detections: counted rules, two-stage sequences and kill-chain patterns, with the default sets."""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Name, event types, threshold, window in seconds, what is counted by, whether severity is raised.
COUNT_RULES = [
    ("brute_force_ssh", ["FailedAuth", "SSH"], 5, 60, "src", True),
    ("port_scan", ["PortScan", "Probe"], 10, 30, "src", False),
    ("data_exfiltration", ["LargeUpload", "DataExfiltration"], 3, 300, "src", True),
    ("fragment_evasion", ["FragmentOverlap", "FragmentTiny"], 3, 60, "src", True),
    ("fragment_dos", ["FragmentOversized", "FragmentFlood"], 5, 30, "dst", True),
    ("ip_spoofing_campaign", ["IpSpoofBogon", "IpSpoofMartian"], 10, 300, "dst", True),
    ("tcp_session_attack", ["TcpRstInjection", "TcpSessionHijack"], 3, 120, "src", True),
    ("reflection_ddos", ["TcpSynAckReflection", "DnsAmplification"], 50, 60, "dst", True),
    ("wifi_denial_of_service", ["WifiDeauthFlood", "WifiDisassocFlood", "WifiBeaconFlood", "WifiAuthFlood"], 5, 30, "src", True),
    ("evil_twin_campaign", ["WifiEvilTwin", "WifiFakeAp"], 2, 600, "src", True),
    ("wifi_credential_harvest", ["WifiPmkidCapture", "WifiHandshakeCapture", "WifiKarmaAttack"], 3, 300, "src", True),
    ("krack_attack", ["WifiKrackAttack"], 2, 60, "src", True),
]
# Name, first stage, second stage, longest gap in seconds.
SEQUENCE_RULES = [
    ("scan_then_exploit", "PortScan", "Exploit", 3600),
    ("scan_to_wireless_attack", "WifiProbeFlood", "WifiEvilTwin", 600),
    ("evasion_to_attack", "FragmentTiny", "Exploit", 300),
    ("icmp_redirect_hijack", "IcmpRedirect", "TcpSessionHijack", 120),
]
# Tactics in kill-chain order, from 1.
TACTICS = [
    "Reconnaissance", "ResourceDevelopment", "InitialAccess", "Execution", "Persistence", "PrivilegeEscalation", "DefenseEvasion",
    "CredentialAccess", "Discovery", "LateralMovement", "Collection", "CommandAndControl", "Exfiltration", "Impact",
]
# Name, required tactics, optional tactics, least number of required ones.
CHAINS = [
    ("APT-style Intrusion", ["Reconnaissance", "InitialAccess"], ["Execution", "Persistence", "PrivilegeEscalation", "CommandAndControl", "Exfiltration"], 2),
    ("Credential Theft", ["CredentialAccess"], ["LateralMovement", "PrivilegeEscalation"], 1),
    ("Data Breach", ["Collection", "Exfiltration"], ["CommandAndControl"], 1),
    ("Ransomware-like Attack", ["Execution", "Impact"], ["InitialAccess", "PrivilegeEscalation", "DefenseEvasion"], 2),
    ("C2 Activity", ["CommandAndControl"], ["Exfiltration", "Execution"], 1),
    ("Wireless Network Compromise", ["CredentialAccess"], ["Reconnaissance", "LateralMovement", "Exfiltration"], 1),
    ("Network Infrastructure Attack", ["DefenseEvasion", "LateralMovement"], ["CredentialAccess", "Collection"], 2),
    ("Multi-Layer DoS Campaign", ["Impact"], ["DefenseEvasion", "Reconnaissance"], 1),
    ("WiFi-to-Wire Pivot", ["InitialAccess", "LateralMovement"], ["CredentialAccess", "CommandAndControl", "Exfiltration"], 2),
]


def count_matches(events: DataFrame, rules: list = COUNT_RULES) -> DataFrame:
    """event_id, rule, n, elevate: events(event_id, src, dst, type, us) at which a rule's count is reached.

    n counts the rule's event types from the same source (or destination) in the window that ends at the event. One pass
    for all rules: times are stretched by rule, so that every rule's window has one length.
    """
    whole = lcm(*[r[3] for r in rules])
    rows = [(name, t, n, whole // seconds, by, up) for name, types, n, seconds, by, up in rules for t in types]
    dim = F.broadcast(events.sparkSession.createDataFrame(rows, "rule string, type string, least int, stretch int, by string, elevate boolean"))  # a row per rule and type
    e = events.join(dim, "type").withColumn("at", F.col("us") * F.col("stretch"))
    key = F.when(F.col("by") == "dst", F.col("dst").cast("string")).otherwise(F.col("src").cast("string"))
    w = Window.partitionBy("rule", "key").orderBy("at").rangeBetween(1 - whole * 1_000_000, 0)
    return e.withColumn("key", key).withColumn("n", F.count(F.lit(1)).over(w)).filter("n >= least").select("event_id", "rule", "n", "elevate")


def sequence_matches(events: DataFrame, rules: list = SEQUENCE_RULES) -> DataFrame:
    """rule, src, first_us, second_us: a source's first event of the first stage, followed by one of the second within the gap."""
    rows = [(name, t, stage, gap) for name, a, b, gap in rules for stage, t in ((1, a), (2, b))]
    dim = F.broadcast(events.sparkSession.createDataFrame(rows, "rule string, type string, stage int, gap long"))  # two rows per rule
    e = events.join(dim, "type")
    first = e.filter("stage = 1").groupBy("rule", "src").agg(F.min("us").alias("first_us"))
    later = e.filter("stage = 2").select("rule", "src", "us", "gap").join(first, ["rule", "src"])
    return later.filter("us > first_us AND us - first_us < gap * 1000000").groupBy("rule", "src", "first_us").agg(F.min("us").alias("second_us"))


def chain_match(tactics: Column, chains: list = CHAINS) -> Column:
    """Struct (name, confidence, progression) of the best pattern, the first of equals, for an array of tactics seen; null without one."""
    order = F.create_map(*[F.lit(x) for i, t in enumerate(TACTICS) for x in (t, i + 1)])
    options = []
    for i, (name, need, may, least) in enumerate(chains):
        hits = F.size(F.array_intersect(tactics, F.array(*[F.lit(x) for x in need])))
        seen = F.array_intersect(tactics, F.array(*[F.lit(x) for x in (*need, *may)]))
        last = F.array_max(F.transform(seen, lambda t: order[t]))
        confidence = F.least(F.lit(1.0), hits / len(need) * 0.7 + 0.3)
        options.append(F.when(hits >= least, F.struct(confidence.alias("confidence"), F.lit(-i).alias("o"), F.lit(name).alias("name"), (last / len(TACTICS)).alias("progression"))))
    best = F.array_max(F.array(*options))
    return F.when(best.isNotNull(), F.struct(best["name"].alias("name"), best["confidence"].alias("confidence"), best["progression"].alias("progression")))


def incident_hosts(incidents: DataFrame) -> DataFrame:
    """host, incident: each incident under the hosts it was created with, from incidents(incident, created_hosts)."""
    return incidents.select(F.explode(F.array_distinct("created_hosts")).alias("host"), "incident")
