"""Frame decoders on hand-made bytes."""

import struct

import pytest
from pyspark.sql import functions as F

from vigilframe.functions import wire as W

from .test_sources import frame


def one(spark, data, f):
    return spark.createDataFrame([(bytearray(data),)], "b binary").select(f(F.col("b")).alias("x")).first()["x"]


@pytest.mark.parametrize(("vlan", "proto"), [(False, 6), (True, 6), (False, 17)])
def test_ipv4(spark, vlan, proto):
    r = one(spark, frame(b"hello", proto, vlan), W.ipv4)
    assert (r["src_ip"], r["dst_ip"], r["proto"], r["ttl"], r["src_port"], r["dst_port"], r["flags"], r["fragment"]) == ("10.0.0.1", "10.0.0.2", proto, 64, 1234, 80 if proto == 6 else 53, 2 if proto == 6 else None, False)


def test_short_and_other_frames(spark):
    assert one(spark, b"", W.ipv4) is None and one(spark, b"\x00" * 20, W.arp) is None
    assert one(spark, b"\x01\x02", lambda b: W.uint(b, 1, 2)) is None and one(spark, b"\x01\x02", lambda b: W.uint(b, 0, 2)) == 258


def test_arp_and_vlan(spark):
    body = b"\xff" * 6 + b"\x01" * 6 + b"\x08\x06" + struct.pack(">HHBBH", 1, 0x0800, 6, 4, 2) + b"\x0a\x0b\x0c\x0d\x0e\x0f" + bytes([1, 2, 3, 4]) + b"\x00" * 6 + bytes([1, 2, 3, 4])
    r = one(spark, body, W.arp)
    assert tuple(r) == (2, "0a:0b:0c:0d:0e:0f", "1.2.3.4", "1.2.3.4", True)
    assert one(spark, b"\x00" * 12 + b"\x81\x00\x00\x01\x81\x00\x00\x02\x08\x00", W.vlan_hopping) is True
    assert one(spark, frame(vlan=True), W.vlan_hopping) is False
    assert one(spark, frame(vlan=True), W.ethernet)["vlan"] == 5


def test_dns(spark):
    msg = struct.pack(">HHHHHH", 7, 0x8183, 1, 0, 0, 0) + b"\x03www\x07example\x03com\x00\x00\x01\x00\x01"
    assert tuple(one(spark, msg, W.dns_header)) == (7, True, 3, 1, 0) and one(spark, msg, W.dns_name) == "www.example.com"


def test_client_hello(spark):
    ciphers = struct.pack(">HHH", 0x1301, 0x0A0A, 0xC02F)
    hello = b"\x16\x03\x01\x00\x00\x01\x00\x00\x00\x03\x03" + b"\x00" * 32 + b"\x02ab" + struct.pack(">H", len(ciphers)) + ciphers
    r = one(spark, hello, W.client_hello)
    assert r["version"] == 0x0303 and list(r["ciphers"]) == [0x1301, 0xC02F]
    assert one(spark, b"\x17\x03\x03", W.client_hello) is None


def test_small_headers(spark):
    assert one(spark, b"\x08\x00\x00\x00\x00\x00\x2a\x00", W.vxlan_vni) == 42
    assert tuple(one(spark, struct.pack(">HHI", 0x2000, 0x0800, 99), W.gre)) == (0x0800, 99)
    assert tuple(one(spark, b"\x86\x00\x00\x00\x40\x00\x07\x08", W.icmpv6_ra)) == (64, 1800)
    assert tuple(one(spark, b"\x80\x00", W.frame_type)) == (0, 8)
    bpdu = b"\x00\x00\x00\x00\x01" + struct.pack(">H", 4096) + b"\x01" * 6 + b"\x00" * 4 + struct.pack(">H", 8192) + b"\x02" * 6
    assert tuple(one(spark, bpdu, W.stp)) == (4096, "01:01:01:01:01:01", 8192, "02:02:02:02:02:02", True)
    got = [spark.range(1).select(W.eapol_message(F.lit(k)).alias("m")).first()["m"] for k in (0x008A, 0x010A, 0x13CA, 0x030A)]
    assert got == [1, 2, 3, 4]
