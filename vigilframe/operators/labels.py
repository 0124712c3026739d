"""Labels read off text: priorities of answers, types and modules of activity, families of attacks, and mail addresses that look made up or relay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .protocol_rules import domain_of, first_case

# Words by priority, by type and by module of activity, and by type of detection, in the order in which they are tried.
PRIORITIES = [("P1", "CRITICAL"), ("P2", "HIGH"), ("P3", "MEDIUM"), ("P4", "LOW")]
ACTIVITY_TYPES = [(("brute", "auth", "password"), "brute_force"), (("scan", "port"), "scan"), (("http", "web", "sql"), "web_attack"), (("dos", "flood"), "dos")]
ACTIVITY_MODULES = [(("http", "nginx", "web"), "http_detect"), (("signature", "rule"), "signatures")]
ATTACK_WORDS = {
    "PortScan": ("scan", "recon"), "NetworkScan": ("scan", "recon"), "BruteForce": ("brute", "patator", "password", "auth"), "DoS": ("dos", "flood", "denial", "ddos"), "SqlInjection": ("sql", "injection"), "Xss": ("xss",),
    "WebAttack": ("web", "http"), "DataExfiltration": ("infiltr", "exfiltr", "botnet"), "Intrusion": ("infiltr", "exfiltr", "botnet"), "TlsHeartbleed": ("heartbleed",),
}
ANY_ATTACK = ["SignatureMatch", "AnomalyDetection"]


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def triage_priority(answer: Column) -> Column:
    """P1 to P4 of an answer: its JSON string `priority` if it is JSON with one, even where that names none; else the first name that its text contains."""
    named = F.upper(F.get_json_object(answer, "$.priority"))
    is_text = answer.rlike(r'"priority"\s*:\s*"') & named.isNotNull()
    upper = F.upper(answer)
    return F.when(is_text, first_case([(named.isin(*p), p[0]) for p in PRIORITIES])).otherwise(first_case([(_has(upper, p), p[0]) for p in PRIORITIES]))


def activity_type(details: Column) -> Column:
    return F.coalesce(first_case([(_has(F.lower(details), w), name) for w, name in ACTIVITY_TYPES]), F.lit("unknown"))


def activity_module(details: Column) -> Column:
    return F.coalesce(first_case([(_has(F.lower(details), w), name) for w, name in ACTIVITY_MODULES]), F.lit("layer234"))


def attack_matches(detection: Column, attack: Column) -> Column:
    """Whether a type of detection covers an attack's label; general types cover any, unknown ones none."""
    low = F.lower(attack)
    out = detection.isin(ANY_ATTACK)
    for kind, words in ATTACK_WORDS.items():
        out = F.when(detection == kind, _has(low, words)).otherwise(out)
    return out


def random_looking(local: Column) -> Column:
    """12 bytes or more, and between over half of them the kind of character changes: digit, lower, upper, other."""
    kind = lambda c: F.when(c.rlike("^[0-9]$"), 0).when(c.rlike("^[a-z]$"), 1).when(c.rlike("^[A-Z]$"), 2).otherwise(3)
    kinds = F.transform(F.filter(F.split(local, ""), lambda c: c != ""), kind)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))
    changes = F.aggregate(kinds, start, lambda s, k: F.struct(k.alias("last"), (s["n"] + ((s["last"] >= 0) & (s["last"] != k)).cast("int")).alias("n")))["n"]
    return (F.octet_length(local) >= 12) & (changes / F.greatest(F.octet_length(local), F.lit(1)) > 0.5)


def open_relay(sender: Column, recipients: Column, local_domains: list[str]) -> Column:
    """A sender from outside and recipients that all are outside, one at least. An address without a domain is outside."""
    outside = lambda a: F.coalesce(~domain_of(a).isin([d.lower() for d in local_domains]), F.lit(True))
    return outside(sender) & (F.size(recipients) > 0) & F.forall(recipients, outside)
