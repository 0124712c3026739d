"""Alerts from the state of flows, spoofed sources, ICMP windows and access points: literal cases."""

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import protocol_alerts as PA


def said(df, make):
    return [(a["severity"], a["message"]) for a in df.select(make(df).alias("a")).first()["a"]]


def test_dns(spark):
    m = [("f", True, 3, "x", "A")] * 9 + [("f", False, 0, "ok.com", "A")] * 9 + [("g", True, 3, "x", "A")] * 6 + [("g", False, 0, "bad.tk", "A")] * 10 + [("h", False, 0, "x.y", "A")] * 101
    df = spark.createDataFrame(m, "f string, response boolean, rcode int, name string, kind string")
    got = {r["f"]: [a["message"] for a in r["a"]] for r in PA.dns_state(df, ["f"]).select("f", PA.dns_alerts(df).alias("a")).collect()}
    assert got == {"f": [], "g": ["Potential DGA activity - 6 NXDOMAIN out of 10 queries", "Queries to suspicious TLD: 10"], "h": ["High DNS query rate: 101 queries"]}
    many = "abcdefghijklmnopqrstuvwxyz0123456789"
    names = [("a" * 64, "A", True), ("a" * 63, "A", False), (many[:31], "A", True), (many[:30], "A", False), (".".join("abcdefg"), "A", False), (".".join("abcdefgh"), "A", True), ("aa." * 6 + "a" * 90, "TXT", True), ("b." + "a" * 50 + "." + "c" * 50, "TXT", True), ("b." + "a" * 50 + "." + "c" * 50, "A", False)]
    t = spark.createDataFrame(names, "name string, kind string, want boolean").select("name", PA.dns_tunnel(F.col("name"), F.col("kind")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in t), [r for r in t if r["got"] != r["want"]]


def test_ssh_smtp_tls(spark):
    ssh = spark.createDataFrame([(1, "h", "s", ["a", "b"], ["CVE-1"], "OpenSSH_5", 3, "root")], "protocol int, bad_hassh string, bad_software string, weak array<string>, cves array<string>, software string, failures long, username string")
    assert [s for s, _ in said(ssh, PA.ssh_alerts)] == ["Critical", "High", "Medium", "Medium", "High", "High", "Medium"]
    quiet = spark.createDataFrame([(2, None, None, [], [], "x", 2, "rooty")], ssh.schema)
    assert said(quiet, PA.ssh_alerts) == []
    schema = "attachments array<string>, spam array<string>, phishing array<string>, spoofed boolean, failures long, transactions long, recipients long, username string, tls boolean"
    assert said(spark.createDataFrame([(["a.exe", "b.scr"], [], [], False, 2, 9, 50, "u", False)], schema), PA.smtp_alerts) == [
        ("High", "Dangerous email attachment: a.exe, b.scr"), ("Medium", "Mass mailer detected: 9 transactions, 50 recipients"), ("Medium", "SMTP authentication without TLS - credentials may be exposed"),
    ]
    assert said(spark.createDataFrame([([], [], [], False, 2, 9, 49, "u", True)], schema), PA.smtp_alerts) == []
    assert said(spark.createDataFrame([("x", 770)], "bad_ja3 string, version int"), PA.tls_alerts) == [("High", "Suspicious JA3 fingerprint detected: x"), ("Medium", "Deprecated TLS version: 770")]
    assert said(spark.createDataFrame([(None, 771)], "bad_ja3 string, version int"), PA.tls_alerts) == []


def test_smb(spark):
    schema = "smb1 boolean, failures long, lateral boolean, ransomware boolean, suspicious long, shares array<string>, pipes array<string>"
    got = said(spark.createDataFrame([(True, 5, True, True, 6, ["\\\\s\\ADMIN$", "D$", "data"], ["\\PIPE\\SVCCTL", "x"])], schema), PA.smb_alerts)
    assert got == [
        ("Medium", "SMB1 protocol detected - legacy and vulnerable"), ("High", "SMB authentication brute force detected - 5 failures"), ("High", "Potential lateral movement via SMB detected"),
        ("Critical", "Potential ransomware activity - 6 suspicious files accessed"), ("High", "Admin share access: \\\\s\\ADMIN$"), ("Medium", "Hidden drive share access: D$"), ("Medium", "Suspicious named pipe access: \\PIPE\\SVCCTL"),
    ]
    assert said(spark.createDataFrame([(False, 4, False, False, 0, None, None)], schema), PA.smb_alerts) == []


def test_http(spark):
    rows = [("f", 1, "/a/../b?x=' or 1", "Bot/1", None), ("f", 2, "/x?1=1", "Firefox", None)] + [("f", 3 + i, None, None, 404) for i in range(11)] + [("f", 20 + i, None, None, 200) for i in range(10)] + [("g", 1, "/admin?q=1=1", None, None), ("g", 2, None, None, 500)]
    df = spark.createDataFrame(rows, "f string, k int, uri string, agent string, status int")
    s = PA.http_state(df, ["f"], ["k"])
    got = {r["f"]: [a["message"] for a in r["a"]] for r in s.select("f", PA.http_alerts(s).alias("a")).collect()}
    assert got == {"f": ["HTTP path traversal attempt detected", "HTTP SQL injection attempt detected", "Suspicious HTTP User-Agent detected: Firefox", "High HTTP error rate: 52.4%"], "g": ["HTTP SQL injection attempt detected"]}


@pytest.mark.parametrize(("ip", "strict", "loose"), [("10.1.1.1", "bogon", None), ("127.0.0.1", "bogon", "bogon"), ("169.254.3.3", "bogon", None), ("0.1.2.3", "bogon", "bogon"), ("240.0.0.1", "bogon", "bogon"), ("8.8.8.8", None, None), ("198.19.255.255", "bogon", "bogon"), ("198.20.0.0", None, None)])
def test_spoofed_sources(spark, ip, strict, loose):
    n = sum(int(p) << (24 - 8 * i) for i, p in enumerate(ip.split(".")))
    row = spark.range(1).select(PA.spoofed_source(F.lit(n), ()).alias("a"), PA.spoofed_source(F.lit(n)).alias("b"), PA.spoofed_source(F.lit(n), (), [f"{ip}/32"]).alias("c")).first()
    assert tuple(row) == (strict, loose, None)


def test_land_and_shares(spark):
    p = spark.createDataFrame([("a", 5, 5, 80, 80), ("a", 0, 9, 1, 2), ("b", 5, 5, 0, 0), ("b", 134744072, 1, 1, 1)], "k string, src_num long, dst_num long, src_port int, dst_port int")
    got = {r["k"]: tuple(r)[1:] for r in PA.spoof_features(p, ["k"]).collect()}
    assert got == {"a": (1.0, 0.0, 0.0, 1.0), "b": (0.5, 0.0, 0.0, 0.0)}


def test_icmp_windows(spark):
    rows = [("a", 0, 5), ("a", 2_000_000, 5), ("a", 10_000_000, 3), ("a", 10_000_001, 5), ("a", 10_050_000, 5)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, us long, type int, event_id long")
    got = [(round(r["redirect"], 4), round(r["unreachable"], 4)) for r in PA.icmp_rates(df, ["k"]).orderBy("event_id").collect()]
    assert got == [(10.0, 0.0), (1.0, 0.0), (0.2, 0.1), (10.0, 0.0), (20.0, 0.0)]


def test_access_points(spark):
    s = 1_000_000
    rows = [(1, 0, "old", 3, "w", -10), (1, 400 * s, "net", None, None, -51), (1, 500 * s, "other", 6, None, -50), (2, 510 * s, "net", 1, None, None), (3, 100 * s, "net", 1, None, -1), (4, 505 * s, "lone", None, None, -7)]
    b = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "bssid long, us long, ssid string, channel int, rsn string, signal int, event_id long")
    got = {r["bssid"]: tuple(r)[1:] for r in PA.access_points(b, spark.createDataFrame([(1,), (1,), (9,)], "bssid long"), F.lit(520 * s)).collect()}
    assert got == {1: ("net", 6, None, 2, -50, True, True), 2: ("net", 1, None, 1, None, False, True), 4: ("lone", 0, None, 1, -7, False, False)}


def test_shares_have_the_decimals_of_printf(spark):
    rows = [(e, n) for n in [*range(11, 321), 400, 2000, 4000] for e in range(n // 2 + 1, n + 1)] + [(1151, 2000), (9, 16), (11, 16)]
    df = spark.createDataFrame(rows, "errors long, responses long").withColumn("share", F.col("errors") * 100 / F.col("responses"))
    wrong = [r for r in df.select("share", PA.tenths(F.col("share")).alias("t")).collect() if r["t"] != f"{r['share']:.1f}"]
    assert wrong == []
    s = spark.createDataFrame([(False, False, None, 16, 11), (False, False, None, 32, 18)], "traversal boolean, injection boolean, bad_agent string, responses long, errors long")
    assert [r["a"][0]["message"] for r in s.select(PA.http_alerts(s).alias("a")).collect()] == ["High HTTP error rate: 68.8%", "High HTTP error rate: 56.2%"]
