"""Labels read off texts and addresses: literal cases."""

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import labels as L


def rows(spark, values, make, schema="x string"):
    return [r["y"] for r in spark.createDataFrame(list(enumerate(values)) if "," not in schema else [(i, *v) for i, v in enumerate(values)], f"i int, {schema}").orderBy("i").select(make.alias("y")).collect()]


def test_priorities(spark):
    answers = ['{"priority": "critical"}', '{"priority": "x", "a": "P1"}', '{"priority": 3, "a": "high"}', '{"other": "low"}', "P2 or P1", "medium", "nothing", "", None]
    assert rows(spark, answers, L.triage_priority(F.col("x"))) == ["P1", None, "P2", "P4", "P1", "P3", None, None, None]


def test_activity(spark):
    texts = ["Port of SQL", "failed PASSWORD scan", "sql rule", "SYN flood", "calm", None]
    assert rows(spark, texts, L.activity_type(F.col("x"))) == ["scan", "brute_force", "web_attack", "dos", "unknown", "unknown"]
    assert rows(spark, ["nginx rule", "rule", "x"], L.activity_module(F.col("x"))) == ["http_detect", "signatures", "layer234"]


def test_attack_families(spark):
    pairs = [("PortScan", "Recon ping"), ("BruteForce", "FTP-Patator"), ("DoS", "xss"), ("SignatureMatch", "Benign"), ("Unheard", "scan"), ("Xss", "XSS")]
    assert rows(spark, pairs, L.attack_matches(F.col("x"), F.col("z")), "x string, z string") == [True, True, False, True, False, True]


@pytest.mark.parametrize(("local", "want"), [("a1b2c3d4e5f6", True), ("a1b2c3d4e5f", False), ("first.lastname", False), ("aB-1aB-1aB-1", True), ("aabbaabb1122", False), ("a1b2c3ääääää", False), ("", False)])
def test_random_looking(spark, local, want):
    assert rows(spark, [local], L.random_looking(F.col("x"))) == [want]


def test_open_relay(spark):
    cases = [("a@out.org", ["b@out.org"]), ("a@Home.net", ["b@out.org"]), ("a@out.org", ["b@HOME.net", "c@out.org"]), ("a@out.org", []), ("nobody", ["nowhere"]), ("Bob <a@out.org>", ["<x@far.net>"])]
    assert rows(spark, cases, L.open_relay(F.col("x"), F.col("z"), ["Home.net"]), "x string, z array<string>") == [True, False, False, False, True, True]
