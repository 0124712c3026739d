"""Readers, parsers and lookups on literal cases."""

import ipaddress
import random
import struct

import pytest
from pyspark.sql import functions as F

from vigilframe.functions import plugins
from vigilframe.operators import anomaly, lookups, rules, textscan
from vigilframe.sources import feeds, pcap, sinks


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_feeds(spark, tmp_path):
    drop = feeds.spamhaus(spark, put(tmp_path, "drop", "; comment\n1.2.3.0/24 ; SBL1\n\n# x\n5.6.0.0/16 ; SBL2\n"))
    et = feeds.plain_ips(spark, put(tmp_path, "et", "# c\n9.9.9.9\n8.8.0.0/16\n"))
    url = feeds.urlhaus(spark, put(tmp_path, "url", '# id,date\n"1","2024","http://x.tk/a","online","x","malware","t","l","r"\n'))
    ssl = feeds.sslbl(spark, put(tmp_path, "ssl", f"# h\n2024,{'AB' * 20},Dridex\n2024,short,x\n"))
    c2 = feeds.feodo(spark, put(tmp_path, "c2", '"2024","7.7.7.7","443","online","2024","Emotet"\n"first_seen","dst_ip","p","s","l","m"\n'))
    got = {(r["value"], r["ioc_type"]) for r in feeds.union_feeds(drop, et, url, ssl, c2, et).collect()}
    assert got == {("1.2.3.0/24", "cidr"), ("5.6.0.0/16", "cidr"), ("9.9.9.9", "ip"), ("8.8.0.0/16", "cidr"), ("http://x.tk/a", "url"), ("ab" * 20, "cert_sha1"), ("7.7.7.7", "ip")}
    assert {r["ip"] for r in feeds.whitelist(spark, put(tmp_path, "wl", "# a\n10.0.0.1\n10.0.0.1\nnonsense!\n")).collect()} == {"10.0.0.1"}


def test_ground_truth_and_flow_records(spark, tmp_path):
    g = feeds.ground_truth(spark, put(tmp_path, "g.csv", "timestamp,src_ip,dst_ip,attack_type,severity\n1700000000,1.1.1.1,2.2.2.2,scan,HIGH\n,1.1.1.2,,brute,weird\nx,notip,,a,b\n")).collect()
    assert sorted((r["src_ip"], r["dst_ip"], r["severity"], r["ts"] is None) for r in g) == [("1.1.1.1", "2.2.2.2", "high", False), ("1.1.1.2", None, "medium", True)]
    line = lambda label: ",".join(["x", "3.3.3.3", "1", "4.4.4.4"] + ["0"] * 79 + [label])
    c = feeds.cicids(spark, put(tmp_path, "c.csv", "\n".join([line("Label"), line("BENIGN"), line("DDoS"), "short,line"]))).collect()
    assert sorted((r["label"], r["attack"]) for r in c) == [("BENIGN", False), ("DDOS", True)]
    n = feeds.netflow(spark, put(tmp_path, "n.csv", "IPV4_SRC_ADDR,Extra,IPV4_DST_ADDR,L4_DST_PORT,IN_BYTES,Label\n1.1.1.1,e,2.2.2.2,80,77,1\n")).first()
    assert (n["client_ip"], n["server_ip"], n["server_port"], n["fwd_bytes"], n["label"], n["bwd_bytes"]) == ("1.1.1.1", "2.2.2.2", 80, 77, 1, None)


def test_logs(spark, tmp_path):
    log = put(tmp_path, "auth", "Dec  6 10:00:01 h sshd[1]: Failed password for invalid user bob from 5.5.5.5 port 22 ssh2\nDec  6 10:00:02 h sshd[1]: Invalid user eve from 6.6.6.6\nnothing\nDec 16 09:00:00 h postfix: warning: unknown[7.7.7.7]: SASL LOGIN authentication failed\n")
    got = [(r["ip"], r["event_type"], str(r["ts"])) for r in feeds.service_log(spark, log, 2025).collect()]
    assert got == [("5.5.5.5", "failed_password", "2025-12-06 10:00:01"), ("6.6.6.6", "invalid_user", "2025-12-06 10:00:02"), ("7.7.7.7", "sasl_failure", "2025-12-16 09:00:00")]
    acc = put(tmp_path, "acc", '1.1.1.1 - - [06/Dec/2025:10:00:00 +0000] "GET /a?id=1%20union%20select HTTP/1.1" 404 12 "-" "sqlmap/1.0"\n2.2.2.2 - - [x] "GET /ok HTTP/1.1" 200 5 "-" "Mozilla"\nbad\n')
    assert [(r["ip"], r["status"], r["kind"]) for r in feeds.access_log(spark, acc).collect()] == [("1.1.1.1", 404, "sql_injection"), ("2.2.2.2", 200, None)]
    scan = put(tmp_path, "scan", "kernel: [SYN SCAN] IN=eth0 SRC=1.2.3.4 DST=5.6.7.8 DPT=3389\nkernel: other SRC=9.9.9.9\n")
    assert [tuple(r) for r in feeds.port_scan_log(spark, scan).collect()] == [("1.2.3.4", 3389, "syn")]


def test_rules(spark, tmp_path):
    path = put(tmp_path, "a.rules", '# c\nalert tcp $NET any -> any 22 (msg:"a \\"q\\""; content:"|41 42|cd"; nocase; offset:2; depth:9; content:!"no"; sid:7; rev:2; threshold:type both, track by_src, count 5, seconds 60;)\nnot a rule\n')
    r = feeds.rules(spark, path, variables={"NET": "10.0.0.0/8"}, disabled=[7]).first()
    assert (r["sid"], r["src"], r["enabled"], r["threshold"]["count"], r["threshold"]["type"]) == (7, "10.0.0.0/8", False, 5, "both")
    assert [tuple(c) for c in r["contents"]] == [("ABcd", False, True, 2, 9, False), ("no", True, False, 0, None, False)]
    cl = feeds.classifications(spark, put(tmp_path, "cl", "# x\nconfig classification: web-attack,Web Attack,1\n")).first()
    assert tuple(cl) == ("web-attack", "Web Attack", 1)


@pytest.mark.parametrize(("spec", "port", "want"), [("any", 1, True), ("80", 80, True), ("80", 81, False), ("[80,443]", 443, True), ("1000:2000", 1500, True), ("1000:", 999, False), (":10", 5, True), ("!80", 80, False), ("![1:5,9]", 9, False), ("![1:5,9]", 7, True)])
def test_rule_ports(spark, spec, port, want):
    assert spark.range(1).select(rules.port_predicate(F.lit(spec), F.lit(port))).first()[0] is want


@pytest.mark.parametrize(("content", "payload", "want"), [('content:"abc";', "xxabc", True), ('content:"ABC"; nocase;', "xxabc", True), ('content:"ABC";', "xxabc", False), ('content:"abc"; offset:3;', "abcxx", False), ('content:"abc"; depth:4;', "xxabc", False), ('content:!"abc";', "xx", True), ('content:!"abc";', "abc", False), ('content:"a"; content:"b";', "ba", True)])
def test_content(spark, content, payload, want):
    r = rules.parse_rules(spark.createDataFrame([(f'alert tcp any any -> any any (msg:"m"; {content} sid:1;)',)], "value string"))
    got = rules.match_rules(spark.createDataFrame([(1, payload)], "id long, p string"), r, "id", "p").count()
    assert (got == 1) is want


def test_flag_specs(spark):
    got = [tuple(spark.range(1).select(rules.tcp_flags_spec(F.lit(s)).alias("x")).first()[0]) for s in ("S", "SA", "S,12", "+F", "*SR", "!A")]
    assert got == [("exact", 2), ("exact", 18), ("exact", 2), ("plus", 1), ("any", 6), ("not", 16)]


def test_networks_against_ipaddress(spark):
    r = random.Random(3)
    cidrs = [f"{r.randint(1, 3)}.{r.randint(0, 3)}.{r.randint(0, 3)}.0/{r.choice([8, 12, 16, 20, 24, 28, 32])}" for _ in range(40)] + ["1.2.3.4"]
    nets = lookups.cidr_bounds(spark.createDataFrame([(c,) for c in cidrs], "cidr string"), "cidr").groupBy("prefix", "lo").agg(F.min("cidr").alias("cidr"))
    ips = [f"{r.randint(1, 4)}.{r.randint(0, 4)}.{r.randint(0, 4)}.{r.randint(0, 255)}" for _ in range(300)] + ["1.2.3.4"]
    df = spark.createDataFrame([(i,) for i in sorted(set(ips))], "ip string").withColumn("num", lookups.ip_to_long(F.col("ip")))
    for row in lookups.cidr_join(df, "num", nets).collect():
        holds = [n.prefixlen for n in (ipaddress.ip_network(c, strict=False) for c in cidrs) if ipaddress.ip_address(row["ip"]) in n]
        assert row["prefix"] == (max(holds) if holds else None)
    assert df.sparkSession.range(1).select(lookups.ip_to_long(F.lit("1.2.3.999"))).first()[0] is None


def test_suffixes(spark):
    assert spark.range(1).select(lookups.suffixes(F.lit("A.b.Example.com"))).first()[0] == ["a.b.example.com", "b.example.com", "example.com"]


def test_versions(spark):
    v = lambda s: spark.range(1).select(lookups.version_parts(F.lit(s)).alias("v")).first()[0]
    assert tuple(v("8.9p1")) == (8, 9, 0, 1) and tuple(v("10.2.3")) == (10, 2, 3, 0) and v("10.0.0") > v("9.9.9")


def frame(payload=b"hello", proto=6, vlan=False):
    l4 = struct.pack(">HHIIBBHHH", 1234, 80, 1, 2, 5 << 4, 2, 100, 0, 0) if proto == 6 else struct.pack(">HHHH", 1234, 53, 8 + len(payload), 0)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(l4) + len(payload), 7, 0, 64, proto, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    tag = b"\x81\x00\x00\x05" if vlan else b""
    return b"\xaa" * 12 + tag + b"\x08\x00" + ip + l4 + payload


def test_pcap(spark, tmp_path):
    frames = [frame(), frame(b"q", 17), frame(vlan=True), b"\x00" * 60]
    body = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 10, 5, len(f), len(f)) + f for f in frames)
    (tmp_path / "a.pcap").write_bytes(body)
    (tmp_path / "b.pcap").write_bytes(b"junk")
    got = sorted(pcap.read_pcap(spark, str(tmp_path / "*.pcap")).collect(), key=lambda r: r["packet_id"])
    assert [(r["packet_id"], r["us"], r["src_ip"], r["proto"], r["dst_port"], r["flags"], r["vlan"], bytes(r["payload"])) for r in got] == [
        (0, 10_000_005, "10.0.0.1", 6, 80, 2, None, b"hello"), (1, 10_000_005, "10.0.0.1", 17, 53, 0, None, b"q"), (2, 10_000_005, "10.0.0.1", 6, 80, 2, 5, b"hello")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00", 3, "a"), (2, "2024-01-02 10:00:00", 1, "b")], "id long, ts string, severity int, line string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    sinks.append_events(df, str(tmp_path / "t"))
    sinks.write_lines(df, "line", str(tmp_path / "l"))
    assert [(r["id"], str(r["day"])) for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [(1, "2024-01-01")]
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["a", "b"]


@pytest.mark.parametrize(("text", "want"), [("", 0.0), ("aaaa", 0.0), ("abcd", 2.0), ("aabb", 1.0)])
def test_char_entropy(spark, text, want):
    assert spark.range(1).select(textscan.char_entropy(F.lit(text))).first()[0] == pytest.approx(want)


def test_text_predicates(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(textscan.is_dga(F.lit("xk3j9q8w7zt5.com"))) and not one(textscan.is_dga(F.lit("example.com")))
    assert one(textscan.is_tunnel(F.lit("a" * 64 + ".com"))) and not one(textscan.is_tunnel(F.lit("www.example.com")))
    assert one(textscan.typosquat(F.lit("examp1e.com"))) and not one(textscan.typosquat(F.lit("example.com")))
    assert one(textscan.sanitize(F.lit("mail a.b@c.org from 1.2.3.4 password=abc"))) == "mail [EMAIL] from [IP] [CREDENTIAL]"
    assert one(textscan.real_client(F.lit("10.0.0.1, 5.5.5.5"), F.array(F.lit("10.0.0.1")))) == "5.5.5.5"
    assert one(textscan.recommended_action(textscan.match_list(F.lit("/x?page=1&a=<script"), textscan.HTTP_PATTERNS))) == "alert"


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 450, 1000])
def test_chunks_cover_the_text_and_end(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    got = sorted((r["chunk"], r["piece"]) for r in textscan.chunks(spark.createDataFrame([(text,)], "t string"), "t", 100, 20).collect())
    back = "".join(p if i == 0 else p[20:] for i, p in got)
    assert back == text and all(len(p) <= 100 for _, p in got)


def test_plugins(spark):
    reg = plugins.Registry()
    df = spark.range(3)
    assert reg.evaluate(df).count() == 0
    reg.add("even", lambda d: plugins.result("even", F.col("id") % 2 == 0, F.lit(7.0), 2, "alert"))
    assert sorted(tuple(r) for r in plugins.to_detections(reg.evaluate(df), "id").collect()) == [(0, "even", 2, 1.0, "alert"), (2, "even", 2, 1.0, "alert")]
    with pytest.raises(ValueError):
        reg.add("even", lambda d: None)


def test_votes_and_calibration(spark):
    import numpy as np

    s = [F.lit(0.2), F.lit(0.9), F.lit(0.7)]
    got = spark.range(1).select(*[anomaly.vote(s, [1, 1, 2], h).alias(h) for h in ("average", "weighted", "max", "min", "median", "hard")]).first()
    assert [round(x, 6) for x in got] == [0.6, 0.625, 0.9, 0.2, 0.7, 1.0]
    assert anomaly.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.0, 2.5, 2.5, 4.0]
    x = np.random.default_rng(0).normal(size=(500, 2))
    x[0] = [9, 9]
    score = anomaly.IsolationForest(x, seed=1).score(x)
    assert score.argmax() == 0 and 0 < score.min() < score.max() < 1
