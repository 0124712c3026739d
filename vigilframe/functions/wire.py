"""Link- and network-layer fields of binary frames as column expressions: no Python runs, scans stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uint(b: Column, at: int | Column, n: int = 1) -> Column:
    """Unsigned big-endian number of n bytes (7 at most) from 0-based position `at`; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    piece = F.substring(b, at + 1, F.lit(n))
    return F.when(F.octet_length(piece) == n, F.conv(F.hex(piece), 16, 10).cast("long"))


def mac(b: Column, at: int) -> Column:
    h = F.lower(F.hex(F.substring(b, F.lit(at + 1), F.lit(6))))
    return F.when(F.length(h) == 12, F.concat_ws(":", *[F.substring(h, 2 * i + 1, 2) for i in range(6)]))


def ip4(b: Column, at: int | Column) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    parts = [uint(b, at + i) for i in range(4)]
    return F.when(parts[3].isNotNull(), F.concat_ws(".", *[p.cast("string") for p in parts]))


def ethernet(b: Column) -> Column:
    """Addresses, VLAN (null without a tag), and the inner type with where its body begins."""
    outer = uint(b, 12, 2)
    tagged = outer == 0x8100
    return F.struct(mac(b, 0).alias("dst_mac"), mac(b, 6).alias("src_mac"), F.when(tagged, uint(b, 14, 2).bitwiseAND(F.lit(0xFFF))).alias("vlan"), F.when(tagged, uint(b, 16, 2)).otherwise(outer).alias("ethertype"), F.when(tagged, 18).otherwise(14).alias("body"))


def vlan_hopping(b: Column) -> Column:
    """Two stacked 802.1Q tags."""
    return (uint(b, 12, 2) == 0x8100) & uint(b, 16, 2).isin(0x8100, 0x88A8)


def arp(b: Column) -> Column:
    """Operation and addresses of an untagged ARP frame; null for other frames. announcement: sender and target address are equal."""
    s, t = ip4(b, 28), ip4(b, 38)
    return F.when(uint(b, 12, 2) == 0x0806, F.struct(uint(b, 20, 2).alias("operation"), mac(b, 22).alias("sender_mac"), s.alias("sender_ip"), t.alias("target_ip"), (s == t).alias("announcement")))


def ipv4(b: Column) -> Column:
    """Header fields and ports of IPv4 frames, tagged or not; ports are null for other protocols than TCP and UDP."""
    e = ethernet(b)
    at = e["body"]
    head = uint(b, at).bitwiseAND(F.lit(15)).cast("int") * 4
    proto, frag = uint(b, at + 9), uint(b, at + 6, 2)
    l4 = at + head
    port = lambda off: F.when(proto.isin(6, 17) & (frag.bitwiseAND(F.lit(0x1FFF)) == 0), uint(b, l4 + off, 2))
    return F.when(e["ethertype"] == 0x0800, F.struct(
        ip4(b, at + 12).alias("src_ip"), ip4(b, at + 16).alias("dst_ip"), proto.alias("proto"), uint(b, at + 8).alias("ttl"), (frag.bitwiseAND(F.lit(0x3FFF)) != 0).alias("fragment"),
        port(0).alias("src_port"), port(2).alias("dst_port"), F.when(proto == 6, uint(b, l4 + 13)).alias("flags")))


def icmpv6_ra(body: Column) -> Column:
    """Router advertisement fields of an ICMPv6 body."""
    return F.when(uint(body, 0) == 134, F.struct(uint(body, 4).alias("hop_limit"), uint(body, 6, 2).alias("lifetime_s")))


def stp(body: Column) -> Column:
    """Root and sender bridge of a spanning-tree message, and its topology-change bit."""
    return F.when(uint(body, 0, 2) == 0, F.struct(uint(body, 5, 2).alias("root_priority"), mac(body, 7).alias("root_mac"), uint(body, 17, 2).alias("bridge_priority"), mac(body, 19).alias("bridge_mac"), (uint(body, 4).bitwiseAND(F.lit(1)) == 1).alias("topology_change")))


def vxlan_vni(body: Column) -> Column:
    return F.when(uint(body, 0).bitwiseAND(F.lit(8)) == 8, uint(body, 4, 3))


def gre(body: Column) -> Column:
    """Inner protocol and, where the key bit is set, the key."""
    flags = uint(body, 0, 2)
    at = F.when(flags.bitwiseAND(F.lit(0x8000)) != 0, 8).otherwise(4)
    return F.struct(uint(body, 2, 2).alias("protocol"), F.when(flags.bitwiseAND(F.lit(0x2000)) != 0, uint(body, at, 4)).alias("key"))


def eapol_message(key_info: Column) -> Column:
    """Number of a four-way handshake message from its key-information bits: install, ack, MIC, secure."""
    bit = lambda m: key_info.bitwiseAND(F.lit(m)) != 0
    return F.when(bit(0x80) & ~bit(0x100), 1).when(~bit(0x80) & bit(0x100) & ~bit(0x200), 2).when(bit(0x80) & bit(0x100), 3).when(~bit(0x80) & bit(0x100) & bit(0x200), 4)


def dns_header(body: Column) -> Column:
    f = uint(body, 2, 2)
    return F.struct(uint(body, 0, 2).alias("id"), (f.bitwiseAND(F.lit(0x8000)) != 0).alias("response"), f.bitwiseAND(F.lit(15)).alias("rcode"), uint(body, 4, 2).alias("questions"), uint(body, 6, 2).alias("answers"))


def dns_name(body: Column, at: int = 12, most_labels: int = 20) -> Column:
    """The first question's name: labels are walked up to the empty one; a compressed or cut name ends early."""
    start = F.struct(F.lit(at).alias("p"), F.array().cast("array<string>").alias("l"))

    def step(s: Column, _: Column) -> Column:
        n = F.coalesce(uint(body, s["p"]), F.lit(0)).cast("int")
        more = (n > 0) & (n < 64)
        label = F.decode(F.substring(body, s["p"] + 2, n), "ISO-8859-1")
        return F.struct(F.when(more, s["p"] + 1 + n).otherwise(s["p"]).alias("p"), F.when(more, F.concat(s["l"], F.array(label))).otherwise(s["l"]).alias("l"))

    return F.array_join(F.aggregate(F.sequence(F.lit(1), F.lit(most_labels)), start, step)["l"], ".")


def client_hello(body: Column) -> Column:
    """Version and cipher list of a TLS ClientHello record without GREASE values; null for other records."""
    session = uint(body, 43).cast("int")
    at = F.lit(44) + session
    n = (uint(body, at, 2) / 2).cast("int")
    codes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: uint(body, at + 2 + i * 2, 2))).otherwise(F.array().cast("array<bigint>"))
    real = F.filter(codes, lambda c: c.isNotNull() & (c.bitwiseAND(F.lit(0x0F0F)) != 0x0A0A))
    return F.when((uint(body, 0) == 22) & (uint(body, 5) == 1), F.struct(uint(body, 9, 2).alias("version"), real.alias("ciphers")))


def frame_type(body: Column) -> Column:
    """Type and subtype of an 802.11 frame without its radio header."""
    fc = uint(body, 0)
    return F.struct(F.shiftright(fc, 2).bitwiseAND(F.lit(3)).alias("type"), F.shiftright(fc, 4).alias("subtype"))
