"""Rule sets merged by id, log lines behind proxies, and probes: literal cases."""

import pytest
from pyspark.sql import functions as F

from vigilframe.functions import probes
from vigilframe.operators import lookups, proxy_log, rules


def test_later_rules_replace_earlier_ones(spark):
    one = ['alert tcp any any -> any any (msg:"a"; content:"abc"; sid:1; rev:1;)', 'alert udp any any -> any any (msg:"b"; flow:to_server; sid:2; rev:1;)', 'alert tcp any any -> any any (msg:"again"; pcre:"/x/"; sid:2; rev:3;)']
    two = ['drop http any any -> any any (msg:"c"; content:!"abc"; sid:1; rev:0;)', 'drop tcp any any -> any any (msg:"d"; sid:9; rev:1;)']
    sets = [rules.parse_rules(spark.createDataFrame([(x,) for x in s], "value string")).withColumn("enabled", F.col("sid") != 9) for s in (one, two)]
    merged = rules.merge_rule_sets(sets, "rev")
    assert {r["sid"]: r["msg"] for r in merged.collect()} == {1: "c", 2: "again", 9: "d"}
    totals = {r["name"]: r["n"] for r in rules.rule_totals(merged).collect()}
    assert totals == {"total": 3, "action:drop": 2, "action:alert": 1, "protocol:http": 1, "protocol:tcp": 2, "with_content": 1, "with_pcre": 1, "disabled": 1}
    assert rules.rule_totals(merged.filter("sid < 0")).count() == 0


def test_proxied_lines(spark):
    nets = lookups.cidr_bounds(spark.createDataFrame([("104.16.0.0/13",), ("10.0.0.0/8",)], "net string"), "net")
    cases = {
        '104.17.1.1 - - [t] "GET /a HTTP/1.1" 404 5 "-" "agent" "10.1.1.1, 203.0.113.5, 8.8.8.8"': ("104.17.1.1", "203.0.113.5", True, "GET /a HTTP/1.1", 404, "agent", "203.0.113.5"),
        '104.17.1.1 - - [t] "GET /a" 200 5 "-" "agent" "10.1.1.1, unknown"': ("104.17.1.1", None, True, "GET /a", 200, "agent", "104.17.1.1"),
        '203.0.113.9 - - [t] "GET /a" 70000 5 "-" "agent" "1.2.3.4"': ("203.0.113.9", None, False, "GET /a", 0, "agent", "203.0.113.9"),
        '203.0.113.9 - - [t] "GET /a" x 5 "ref" "agent"': ("203.0.113.9", None, False, "GET /a", 0, "ref", "203.0.113.9"),
        '10.3.3.3 - - [t] "GET /a" 301 "lonely': ("10.3.3.3", None, True, "GET /a", 301, "", "10.3.3.3"),
        'name - - [t] "GET /a" 200 5': None, "203.0.113.9 - - nothing quoted": None, "": None, None: None,
    }
    lines = spark.createDataFrame(list(enumerate(cases)), "k int, value string")
    got = {r["k"]: tuple(r)[1:] for r in proxy_log.parse_proxy_log(lines, nets, "k").collect()}
    assert got == {i: v for i, v in enumerate(cases.values()) if v}


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        (b"GET / HTTP/1.1", ("http", 100)), (b"HTTP/1.0 200", ("http", 100)), (b"GET", ("mqtt", 70)), (b"", None), (bytes([22, 3, 1, 0, 5]), ("tls", 100)), (b"SSH-2.0", ("ssh", 100)), (bytes([0, 0, 0, 20, 6, 1]), ("ssh", 90)),
        (b"ehlo x\r\n", ("smtp", 100)), (b"220 ftp ready", ("smtp", 100)), (b"331 password", ("ftp", 90)), (b"user joe", ("ftp", 90)), (b"user \xff", ("mqtt", 70)), (bytes([0, 0, 0, 9]) + b"\xfeSMB", ("smb", 100)), (b"\xffSMB", ("smb", 100)),
        (bytes([5, 0]) + bytes(22), ("dcerpc", 100)), (bytes(236) + bytes([0x63, 0x82, 0x53, 0x63]), ("dhcp", 100)), (b"INVITE sip:a", ("sip", 100)), (b"RFB 003.008\n", ("rfb", 100)), (bytes([0x05, 0x64]) + b"\xff" * 10, ("dnp3", 90)),
        (bytes([3, 0, 0, 9]), ("rdp", 80)), (bytes([0, 1, 0, 0, 0, 6, 1, 3]), ("modbus", 80)), (bytes([0, 1, 9, 9]), ("tftp", 80)), (bytes([0x10, 0]), ("mqtt", 70)), (b"\x6a\xff\xff\xff", ("kerberos", 90)), (bytes(12), ("modbus", 80)),
        (b"\xff" * 17 + b"\x20" + b"\xff" * 12, ("ike", 90)), (b"\x23" + b"\xff" * 47, ("ntp", 85)), (b"\x65\x00" + b"\xff" * 24, ("enip", 85)), (None, None),
    ],
)
def test_probes(spark, payload, want):
    r = spark.createDataFrame([(None if payload is None else bytearray(payload),)], "b binary").select(probes.best_probe(F.col("b")).alias("p")).first()["p"]
    assert (r and tuple(r)) == want


@pytest.mark.parametrize(
    ("payload", "want"),
    [
        (b"INVITE sip:a" + b"x" * 7 + "é".encode(), ("sip", 100)), (b"INVITE sip:a" + b"x" * 6 + "€".encode(), ("sip", 100)), (b"INVITE sip:a" + b"x" * 5 + "\U0001f600".encode(), ("sip", 100)), (b"INVITE sip:a" + b"x" * 7 + "\U0001f600".encode(), ("sip", 100)),
        (b"INVITE sip:a" + b"x" * 7 + b"\xc3", ("mqtt", 70)), (b"INVITE sip:a\xff" + b"x" * 20, ("mqtt", 70)), (b"INVITE sip:a" + b"x" * 8 + b"\xff" * 9, ("sip", 100)), (b"pa\xdf\x80", ("mqtt", 70)),
    ],
)
def test_probes_of_bytes_that_are_not_ascii(spark, payload, want):
    """A character that lies across the 20th byte is none that is broken, and a byte is not made two letters."""
    assert tuple(spark.createDataFrame([(bytearray(payload),)], "b binary").select(probes.best_probe(F.col("b")).alias("p")).first()["p"]) == want
