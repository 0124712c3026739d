"""The 88-element feature vector of a source's packets in one window, and the decision list over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import flows as X

#: Login services, and columns that captures may lack with their types.
AUTH_PORTS = (21, 22, 23, 25, 110, 143, 389, 445, 465, 587, 993, 995, 1433, 3306, 3389, 5432, 5900)
OPTIONAL = {"icmp_type": "int", "icmp_code": "int", "tls_version": "string", "tls_handshake": "int", "sni": "string", "ja3": "string", "src_mac": "string"}
SIZE = 88

#: The decision list, first match wins.
DECISIONS = [
    ("syn_scan", "f12 > 0.6 AND f13 < 0.15 AND f1 > 0.05"),
    ("syn_flood", "f64 > 0.01 AND f12 > 0.7 AND f13 < 0.15 AND f67 > 0.5 AND f1 < 0.1"),
    ("syn_flood", "f68 > 0.4 AND f1 < 0.1"),
    ("connection_exhaustion", "f71 > 0.3 AND f65 < 0.1 AND f1 < 0.1"),
    ("udp_flood", "f69 > 0.3 OR (f64 > 0.01 AND f65 > 0.01 AND f31 > 0.5)"),
    ("icmp_flood", "f70 > 0.3 OR (f64 > 0.01 AND f36 > 0.7 AND f8 < 0.2)"),
    ("xmas_scan", "f22 > 0.5"),
    ("null_scan", "f23 > 0.5"),
    ("brute_force", "f20 > 0.5 AND f21 > 0.7 AND f18 > 0.3 AND f1 < 0.1"),
    ("syn_scan", "f12 > 0.6 AND f13 < 0.15 AND f17 > 0.4"),
    ("syn_scan", "f12 > 0.7 AND f13 < 0.15 AND f17 > 0.6 AND f1 > 0.01"),
    ("connect_scan", "f12 > 0.15 AND f12 < 0.6 AND f14 > 0.15 AND f14 < 0.6 AND f13 < 0.15 AND f19 > 0.5 AND f1 > 0.01"),
    ("ping_sweep", "f36 > 0.4 AND f40 > 0.3"),
    ("ping", "f36 > 0.7 AND f8 < 0.2"),
    ("udp_scan", "f25 > 0.3"),
    ("amplification", "f34 > 0.3"),
]


def _gaps(p: DataFrame, keys: list[str], when: Column, name: str) -> DataFrame:
    """Microseconds since the previous packet of the same kind."""
    w = Window.partitionBy(*keys, f"__{name}").orderBy("us", "packet_id")
    return p.withColumn(f"__{name}", F.coalesce(when, F.lit(False))).withColumn(f"d_{name}", F.when(F.col(f"__{name}"), F.col("us") - F.lag("us").over(w)))


def _regular(name: str, least: int) -> Column:
    """1 - min(1, coefficient of variation) of the gaps, 0 with fewer than `least` packets or no gap."""
    m, s, n = F.col(f"m_{name}"), F.col(f"s_{name}"), F.col(f"n_{name}")
    return F.when((n >= least) & (m > 0), 1 - F.least(F.lit(1.0), s / m)).otherwise(0.0)


def features(packets: DataFrame, keys: list[str]) -> DataFrame:
    """keys and f0 to f87 of each window. Windows hold what one source sends, so features of what it receives are 0.

    packets: packet_id, ts, dst_num, src_port, dst_port, proto, flags, size (payload), ttl, and the OPTIONAL columns as
    far as there are. One pass aggregates; entropies and groups by port, address and MAC are sub-aggregates on the same
    key, joined by it.
    """
    c = F.col
    p = packets.withColumns({k: F.lit(None).cast(t) for k, t in OPTIONAL.items() if k not in packets.columns}).withColumn("us", F.unix_micros("ts"))
    tcp, udp, icmp, icmp6 = (c("proto") == v for v in (6, 17, 1, 58))
    tls, dhcp, ra = c("tls_version").isNotNull(), udp & (c("src_port").isin(67, 68) | c("dst_port").isin(67, 68)), icmp6 & (c("icmp_type") == 134)
    for name, when in (("all", F.lit(True)), ("icmp", icmp), ("tls", tls), ("ra", ra)):
        p = _gaps(p, keys, when, name)
    w = Window.partitionBy(*keys).orderBy("us", "packet_id")
    p = p.withColumn("ttl_step", c("ttl") - F.lag("ttl").over(w))
    syn, synack = tcp & X.has(X.SYN) & X.none_of(X.ACK), tcp & X.has(X.SYN | X.ACK)
    n = {
        "all": F.lit(True), "tcp": tcp, "udp": udp, "icmp": icmp, "tls": tls, "dhcp": dhcp, "ra": ra, "syn": syn, "synack": synack, "rst": tcp & X.has(X.RST), "fin": tcp & X.has(X.FIN), "null": tcp & (c("flags") == 0), "xmas": tcp & X.has(41),
        "auth": tcp & c("dst_port").isin(*AUTH_PORTS), "unreach": icmp & (c("icmp_type") == 3) & (c("icmp_code") == 3), "empty": udp & (c("size") == 0), "dns": udp & (c("dst_port") == 53), "ntp": udp & (c("dst_port") == 123), "ssdp": udp & (c("dst_port") == 1900),
        "req": icmp & c("icmp_type").isin(8, 128), "rep": icmp & c("icmp_type").isin(0, 129), "t31": icmp & c("icmp_type").isin(3, 1), "t113": icmp & c("icmp_type").isin(11, 3), "hello": tls & (c("tls_handshake") == 1), "hand": tls & c("tls_handshake").isNotNull(), "shello": tls & (c("tls_handshake") == 2),
        "v10": tls & c("tls_version").contains("1.0"), "v11": tls & c("tls_version").contains("1.1"), "v12": tls & (c("tls_version").contains("1.2") | c("tls_version").contains("1.3")), "sni": tls & c("sni").isNotNull(), "tlsrst": tls & X.has(X.RST), "d67": dhcp & (c("dst_port") == 67),
    }
    some = lambda when, x: F.when(when, x)
    out = [F.count_if(v).alias(f"n_{k}") for k, v in n.items()]
    for k in ("all", "icmp", "tls", "ra"):
        out += [F.avg(f"d_{k}").alias(f"m_{k}"), F.stddev_pop(f"d_{k}").alias(f"s_{k}")]
    out += [
        ((F.max("us") - F.min("us")) / 1e6).alias("dur"), F.try_divide(F.count_if(c("d_all") < 1000), F.count("d_all")).alias("burst"), F.try_divide(F.count_if(c("d_ra") < 100_000), F.count("d_ra")).alias("ra_burst"), F.try_divide(F.count_if(c("ttl_step") == 1), F.count("ttl_step")).alias("ttl_up"), F.var_pop("ttl").alias("ttl_var"),
        F.count_distinct(some(c("dst_port") != 0, c("dst_port"))).alias("ports"), F.min(some(c("dst_port") != 0, c("dst_port"))).alias("pmin"), F.max(some(c("dst_port") != 0, c("dst_port"))).alias("pmax"), F.count_distinct("dst_num").alias("hosts"), F.count_distinct(F.shiftright("dst_num", 8)).alias("nets"),
        F.stddev_pop(some(udp, c("size"))).alias("udp_std"), F.sum("size").alias("bytes"), F.sum(some(udp, c("size"))).alias("udp_bytes"), F.count_distinct(some(icmp, c("dst_num"))).alias("icmp_hosts"), F.avg(some(icmp, c("size"))).alias("icmp_mean"), F.stddev_pop(some(icmp, c("size"))).alias("icmp_std"),
        F.count_distinct(some(tls, c("ja3"))).alias("ja3s"), F.count_distinct(some(tls, c("sni"))).alias("snis"), F.count_distinct(some(tls, c("dst_num"))).alias("tls_hosts"), F.count_distinct(some(dhcp, c("src_mac"))).alias("dhcp_macs"), F.max((dhcp & (c("src_port") == 67)).cast("int")).alias("dhcp_server"),
    ]
    a = p.groupBy(*keys).agg(*out)
    by_port = p.filter(tcp).groupBy(*keys, "dst_port").agg(F.count(F.lit(1)).alias("__c"), F.bool_or(syn).alias("s"), F.bool_or(synack).alias("sa"), F.bool_or(X.has(X.ACK) & X.none_of(X.SYN)).alias("ak"), F.bool_or(X.has(X.RST)).alias("r"))
    ports = by_port.groupBy(*keys).agg(
        F.avg((c("s") & c("sa") & c("ak")).cast("double")).alias("complete"), F.avg((c("s") & ~c("sa") & ~c("ak")).cast("double")).alias("half"), F.avg((c("s") & c("r") & ~c("sa")).cast("double")).alias("refused"), (F.max("__c") / F.sum("__c")).alias("port_share"))
    macs = p.filter("src_mac IS NOT NULL")
    by_dst = macs.groupBy(*keys, "dst_num").agg(F.count_distinct("src_mac").alias("__c")).groupBy(*keys).agg(F.avg((c("__c") > 3).cast("double")).alias("many_macs"))
    by_mac = macs.groupBy(*keys, "src_mac").agg(F.count_distinct("dst_num").alias("__c")).groupBy(*keys).agg(F.max("__c").alias("mac_hosts"))
    parts = [
        a, ports, by_dst, by_mac, X.entropy(p.filter("dst_port <> 0"), keys, "dst_port", "e_port"), X.entropy(p, keys, "dst_num", "e_dst"), X.entropy(p.filter(icmp & c("icmp_code").isNotNull()), keys, "icmp_code", "e_code"), X.entropy(p.filter(tls), keys, "tls_version", "e_tls"),
        X.sequential_ratio(p, keys, "dst_num", "seq"), X.sequential_ratio(p.filter(n["req"]), keys, "dst_num", "seq_req"),
    ]
    v = X.join_all(parts, keys)
    z = lambda x: F.coalesce(x if isinstance(x, Column) else c(x), F.lit(0.0))
    cap, div = (lambda x: X.cap(z(x))), (lambda a, b: X.ratio(c(f"n_{a}"), c(f"n_{b}")))
    rate = lambda x: F.when(c("dur") > 0, x / c("dur")).otherwise(0.0)
    live = lambda x: F.when(c("dur") >= 0.001, x).otherwise(0.0)
    two = c("n_all") >= 2
    f: dict[int, Column] = {
        0: cap(c("e_port") / 16), 1: cap(c("ports") / 1000), 2: z(c("pmin") / 65535), 3: z(c("pmax") / 65535), 4: F.when(two, cap(c("m_all") / 1e6)).otherwise(0.0), 5: F.when(two, cap(c("s_all") / 1e6)).otherwise(0.0), 6: z("burst"), 7: F.when(two, cap(c("dur") / 60)).otherwise(0.0),
        8: cap(c("hosts") / 100), 9: cap(c("e_dst") / 8), 10: z("seq"), 11: cap(c("nets") / 50), 12: div("syn", "tcp"), 13: div("synack", "tcp"), 14: div("rst", "tcp"), 15: div("fin", "tcp"), 16: z("complete"), 17: z("half"), 18: z("complete"), 19: z("refused"),
        20: div("auth", "tcp"), 21: z("port_share"), 22: div("xmas", "tcp"), 23: div("null", "tcp"), 24: F.when(c("n_udp") > 0, 1 - cap(div("unreach", "udp"))).otherwise(0.0), 25: div("unreach", "udp"), 26: cap(c("udp_std") / 1000), 27: div("empty", "udp"),
        28: div("dns", "udp"), 29: div("ntp", "udp"), 30: div("ssdp", "udp"), 31: F.when(c("n_udp") > 0, (c("n_udp") - c("n_dns") - c("n_ntp") - c("n_ssdp")) / c("n_udp")).otherwise(0.0), 35: F.when(c("n_udp") > 0, 1.0).otherwise(0.0),
        36: div("req", "icmp"), 37: div("rep", "icmp"), 38: div("t31", "icmp"), 39: div("t113", "icmp"), 40: z("seq_req"), 41: z("ttl_up"), 42: cap(c("ttl_var") / 64), 43: z(c("e_code") / 8),
        44: _regular("icmp", 2), 45: F.when(c("n_icmp") >= 2, cap(rate(c("n_icmp")) / 1000)).otherwise(0.0), 46: F.when(c("n_icmp") >= 2, cap(rate(c("icmp_hosts")) / 100)).otherwise(0.0), 47: F.when(c("n_icmp") >= 2, div("rep", "req")).otherwise(0.0),
        48: div("tls", "all"), 49: div("hello", "tls"), 50: div("hand", "tls"), 51: X.ratio(c("ja3s"), c("n_tls")), 52: div("v10", "tls"), 53: div("v11", "tls"), 54: div("v12", "tls"), 55: cap(c("e_tls") / 2), 56: div("sni", "tls"), 57: X.ratio(c("snis"), c("n_tls")), 58: X.ratio(c("ja3s"), c("n_tls")), 59: div("shello", "tls"),
        60: _regular("tls", 2), 61: F.when(c("n_tls") >= 2, cap(rate(c("n_tls")) / 100)).otherwise(0.0), 62: F.when(c("n_tls") >= 2, cap(c("tls_hosts") / 50)).otherwise(0.0), 63: F.when(c("n_tls") >= 2, div("tlsrst", "tls")).otherwise(0.0),
        74: z("many_macs"), 75: cap(c("mac_hosts") / 20), 76: div("d67", "dhcp"), 77: cap(c("dhcp_macs") / 50), 78: z(c("dhcp_server") / 3), 79: cap(rate(c("n_dhcp")) / 100),
        80: cap(F.greatest(c("icmp_mean") - 64, F.lit(0.0)) / 192), 81: F.when((c("icmp_mean") > 64) & (c("icmp_std") * c("icmp_std") > 100), X.cap(c("icmp_std") / 256)).otherwise(0.0), 82: F.when(c("n_req") + c("n_rep") > 0, 2 * F.abs(c("n_req") / (c("n_req") + c("n_rep")) - 0.5)).otherwise(0.0), 83: _regular("icmp", 3),
        84: cap(rate(c("n_ra")) / 5), 85: F.when(c("n_ra") > 0, 1 / F.lit(3.0)).otherwise(0.0), 86: z("ra_burst"),
    }
    v = v.withColumns({f"f{i}": x.cast("double") for i, x in f.items()})
    pps = rate(c("n_all"))
    v = v.withColumns({"f64": live(X.cap(pps / 100_000)), "f65": live(X.cap(rate(z("bytes")) / 125e6)), "f66": live(X.cap(rate(c("n_syn")) / 10_000)), "f67": live(F.when((c("n_tcp") > 0) & (pps > 1000) & (c("n_syn") > 0), 1 - F.least(F.lit(1.0), c("n_synack") / c("n_syn"))).otherwise(0.0))})
    share = X.ratio(c("n_udp"), c("n_all"))
    v = v.withColumns({
        "f68": X.cap((0.4 * c("f64") + 0.3 * c("f66") + 0.3 * c("f67")) * c("f12")),
        "f69": live(F.when(share > 0.5, (0.5 * X.cap(rate(c("n_udp")) / 1e5) + 0.5 * X.cap(rate(z("udp_bytes")) / 125e6)) * share).otherwise(0.0)),
        "f70": live(X.cap(rate(c("n_req")) / 50_000) * F.when(c("icmp_hosts") <= 3, 1.0).otherwise(0.5)),
        "f71": F.when((c("f66") > 0.05) & (c("f67") > 0.5), 0.4 * c("f66") + 0.6 * c("f67")).otherwise(0.0),
    })
    return v.select(*keys, "n_all", *[(c(f"f{i}") if f"f{i}" in v.columns else F.lit(0.0)).alias(f"f{i}") for i in range(SIZE)])


def decide(vectors: DataFrame) -> Column:
    out = None
    for name, when in DECISIONS:
        out = F.when(F.expr(when), name) if out is None else out.when(F.expr(when), name)
    return out


def as_array(vectors: DataFrame) -> Column:
    return F.array(*[F.col(f"f{i}").cast("float") for i in range(SIZE)])
