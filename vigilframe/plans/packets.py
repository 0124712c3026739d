"""Queries over packets: flow keys and flags, flow aggregates, inter-arrival windows, per-source feature windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import flows as X
from ..operators import window_vector as V
from ..operators.stateful import distinct_in_window
from ..sources import tables as T
from .registry import register

P = T.PACKETS
KEYED = f"""{P}, fl AS (
  SELECT *, CASE WHEN src_num < dst_num OR (src_num = dst_num AND src_port <= dst_port) THEN src_num ELSE dst_num END AS ip_a,
            CASE WHEN src_num < dst_num OR (src_num = dst_num AND src_port <= dst_port) THEN src_port ELSE dst_port END AS port_a,
            CASE WHEN src_num < dst_num OR (src_num = dst_num AND src_port <= dst_port) THEN dst_num ELSE src_num END AS ip_b,
            CASE WHEN src_num < dst_num OR (src_num = dst_num AND src_port <= dst_port) THEN dst_port ELSE src_port END AS port_b FROM pkt)"""
K = "ip_a, port_a, ip_b, port_b, proto"
DIRECTED = f"""{KEYED}, f1 AS (SELECT *, first_value(src_num) OVER (PARTITION BY {K} ORDER BY ts, packet_id) AS client FROM fl),
f2 AS (SELECT *, src_num = client AS fwd FROM f1),
f3 AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {K}, fwd ORDER BY ts, packet_id) AS iat FROM f2)"""


def flows(spark, sf):
    return X.flow_aggregate(T.packets(spark, sf), X.FLOW_KEY)


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@register("B01_flow_key", f"WITH {KEYED} SELECT packet_id, {K} FROM fl")
def flow_key(spark, sf):
    return X.with_flow_key(T.packets(spark, sf)).select("packet_id", *X.FLOW_KEY)


@register("B02_five_tuple", f"WITH {P} SELECT packet_id, concat_ws(':', src_num, src_port, dst_num, dst_port, proto) AS tuple FROM pkt")
def five_tuple(spark, sf):
    return T.packets(spark, sf).select("packet_id", F.concat_ws(":", "src_num", "src_port", "dst_num", "dst_port", "proto").alias("tuple"))


@register("B03_flag_predicates", f"""WITH {P} SELECT packet_id, flags & 18 = 2 AS is_syn, flags & 18 = 18 AS is_syn_ack, flags & 1 = 1 AS is_fin, flags & 4 = 4 AS is_rst,
 proto = 6 AND flags = 0 AS is_null, flags = 2 AS is_syn_only, flags & 41 = 41 AS is_xmas FROM pkt""")
def flag_predicates(spark, sf):
    return T.packets(spark, sf).select(
        "packet_id", (X.has(X.SYN) & X.none_of(X.ACK)).alias("is_syn"), X.has(X.SYN | X.ACK).alias("is_syn_ack"), X.has(X.FIN).alias("is_fin"), X.has(X.RST).alias("is_rst"),
        ((F.col("proto") == 6) & (F.col("flags") == 0)).alias("is_null"), (F.col("flags") == X.SYN).alias("is_syn_only"), X.has(X.FIN | X.PSH | X.URG).alias("is_xmas"))


@register("B04_flag_decode", f"WITH {P} SELECT packet_id, flags & 1 > 0 AS fin, flags & 2 > 0 AS syn, flags & 4 > 0 AS rst, flags & 8 > 0 AS psh, flags & 16 > 0 AS ack, flags & 32 > 0 AS urg, flags & 64 > 0 AS ece, flags & 128 > 0 AS cwr FROM pkt")
def flag_decode(spark, sf):
    names = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")
    return T.packets(spark, sf).select("packet_id", *[X.has(1 << i).alias(n) for i, n in enumerate(names)])


@register("B05_fragment", f"WITH {P} SELECT packet_id, packet_id % 5 = 0 OR size % 64 > 60 AS fragment FROM pkt")
def fragment(spark, sf):
    return T.packets(spark, sf).select("packet_id", ((F.col("packet_id") % 5 == 0) | (F.col("size") % 64 > 60)).alias("fragment"))


@register("B10_rule_ports", f"WITH {P} SELECT packet_id FROM pkt WHERE (dst_port IN (22, 80) OR dst_port BETWEEN 8000 AND 9000) AND NOT src_port BETWEEN 40000 AND 40010")
def rule_ports(spark, sf):
    d = F.col("dst_port")
    return T.packets(spark, sf).filter((d.isin(22, 80) | d.between(8000, 9000)) & ~F.col("src_port").between(40000, 40010)).select("packet_id")


@register("B12_rule_tcp_flags", f"WITH {P} SELECT packet_id, proto = 6 AND flags & 63 = 2 AS exact_s, proto = 6 AND flags & 5 <> 0 AS any_fr FROM pkt")
def rule_tcp_flags(spark, sf):
    tcp, f = F.col("proto") == 6, F.col("flags")
    return T.packets(spark, sf).select("packet_id", (tcp & (f.bitwiseAND(F.lit(63)) == 2)).alias("exact_s"), (tcp & (f.bitwiseAND(F.lit(5)) != 0)).alias("any_fr"))


@register("B13_rule_direction", f"WITH {P} SELECT packet_id, CASE WHEN dst_port = 80 THEN 'to_server' WHEN src_port = 80 THEN 'to_client' END AS direction FROM pkt WHERE 80 IN (src_port, dst_port)")
def rule_direction(spark, sf):
    d = F.when(F.col("dst_port") == 80, "to_server").when(F.col("src_port") == 80, "to_client")
    return T.packets(spark, sf).withColumn("direction", d).filter("direction IS NOT NULL").select("packet_id", "direction")


@register("B38_land", f"WITH {P} SELECT packet_id, src_num % 256 = dst_num % 256 AND src_port % 100 = dst_port % 100 AS land FROM pkt")
def land(spark, sf):
    return T.packets(spark, sf).select("packet_id", ((F.col("src_num") % 256 == F.col("dst_num") % 256) & (F.col("src_port") % 100 == F.col("dst_port") % 100)).alias("land"))


@register("B56_inspection_budget", f"WITH {KEYED} SELECT packet_id, rn, CASE WHEN rn <= 3 AND dst_port IN (80, 443, 8080) THEN CASE WHEN size > 250 THEN 'drop' ELSE 'log' END ELSE 'skip' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY ts, packet_id) AS rn FROM fl)")
def inspection_budget(spark, sf):
    w = Window.partitionBy(*X.FLOW_KEY).orderBy("ts", "packet_id")
    p = X.with_flow_key(T.packets(spark, sf)).withColumn("rn", F.row_number().over(w).cast("long"))
    look = (F.col("rn") <= 3) & F.col("dst_port").isin(80, 443, 8080)
    return p.select("packet_id", "rn", F.when(look, F.when(F.col("size") > 250, "drop").otherwise("log")).otherwise("skip").alias("action"))


@register("C04_packet_flow", f"WITH {KEYED} SELECT packet_id, count(*) OVER w AS flow_packets, row_number() OVER (PARTITION BY {K} ORDER BY ts, packet_id) = 1 AS creates FROM fl WINDOW w AS (PARTITION BY {K})")
def packet_flow(spark, sf):
    w = Window.partitionBy(*X.FLOW_KEY)
    p = X.with_flow_key(T.packets(spark, sf))
    return p.select("packet_id", F.count(F.lit(1)).over(w).alias("flow_packets"), (F.row_number().over(w.orderBy("ts", "packet_id")) == 1).alias("creates"))


@register("D05_streaming_stats", f"WITH {P} SELECT src_num, count(*) AS n, min(size) AS mn, max(size) AS mx, round(avg(size), 6) AS mean, round(coalesce(stddev_samp(size), 0), 6) AS std, CAST(sum(size) AS BIGINT) AS total FROM pkt GROUP BY 1")
def streaming_stats(spark, sf):
    return T.packets(spark, sf).groupBy("src_num").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("mn"), F.max("size").alias("mx"), F.round(F.avg("size"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("size"), F.lit(0.0)), 6).alias("std"), F.sum("size").alias("total"))


FLOW_COLS = ["packets", "bytes", "fwd_packets", "fwd_bytes", "bwd_packets", "bwd_bytes", "syn_count", "syn_ack_count", "fin_count", "rst_count", "psh_count", "ack_count", "urg_count"]


@register("D06_flow_aggregate", f"""WITH {DIRECTED} SELECT {K}, min(client) AS client, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (fwd) AS fwd_packets, CAST(coalesce(sum(size) FILTER (fwd), 0) AS BIGINT) AS fwd_bytes,
 count(*) FILTER (NOT fwd) AS bwd_packets, CAST(coalesce(sum(size) FILTER (NOT fwd), 0) AS BIGINT) AS bwd_bytes, count(*) FILTER (flags & 18 = 2) AS syn_count, count(*) FILTER (flags & 18 = 18) AS syn_ack_count, count(*) FILTER (flags & 1 = 1) AS fin_count,
 count(*) FILTER (flags & 4 = 4) AS rst_count, count(*) FILTER (flags & 8 = 8) AS psh_count, count(*) FILTER (flags & 16 = 16) AS ack_count, count(*) FILTER (flags & 32 = 32) AS urg_count FROM f3 GROUP BY {K}""")
def flow_aggregate(spark, sf):
    return flows(spark, sf).select(*X.FLOW_KEY, "client", *FLOW_COLS)


@register("D07_flow_seed", f"WITH {KEYED} SELECT {K}, min_by(src_num, packet_id) AS client_ip, min_by(src_port, packet_id) AS client_port, CASE WHEN min_by(flags, packet_id) & 18 = 2 THEN 1 ELSE 0 END AS seed_syn FROM fl GROUP BY {K}")
def flow_seed(spark, sf):
    first = F.min_by(F.struct("src_num", "src_port", "flags"), F.struct("ts", "packet_id")).alias("f")
    out = X.with_flow_key(T.packets(spark, sf)).groupBy(*X.FLOW_KEY).agg(first)
    return out.select(*X.FLOW_KEY, F.col("f.src_num").alias("client_ip"), F.col("f.src_port").alias("client_port"), F.when(F.col("f.flags").bitwiseAND(F.lit(18)) == 2, 1).otherwise(0).alias("seed_syn"))


@register("D08_flow_statistics", f"""WITH {DIRECTED} SELECT {K}, greatest(0.001, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS duration, round(sum(size) / greatest(0.001, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS bytes_per_s,
 round(count(*) / greatest(0.001, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS packets_per_s, round(coalesce(avg(size) FILTER (fwd), 0), 6) AS fwd_mean, round(coalesce(stddev_samp(size) FILTER (fwd), 0), 6) AS fwd_std,
 max(size) FILTER (fwd) AS fwd_max, min(size) FILTER (fwd) AS fwd_min, round(coalesce(avg(iat) FILTER (fwd), 0), 3) AS fwd_iat_mean, round(coalesce(stddev_samp(iat) FILTER (fwd), 0), 3) AS fwd_iat_std, round(coalesce(avg(iat) FILTER (NOT fwd), 0), 3) AS bwd_iat_mean,
 CASE WHEN count(*) FILTER (fwd) > 0 THEN round(count(*) FILTER (NOT fwd) / count(*) FILTER (fwd), 6) ELSE 0 END AS down_up FROM f3 GROUP BY {K}""")
def flow_statistics(spark, sf):
    f = flows(spark, sf)
    seconds = F.greatest(F.lit(0.001), (F.unix_micros("last_ts") - F.unix_micros("start_ts")) / 1e6)
    r = lambda c, n=6: F.round(F.coalesce(c, F.lit(0.0)), n)
    return f.withColumn("duration", seconds).select(
        *X.FLOW_KEY, "duration", r(F.col("bytes") / F.col("duration")).alias("bytes_per_s"), r(F.col("packets") / F.col("duration")).alias("packets_per_s"), r(F.col("fwd_mean")).alias("fwd_mean"), r(F.col("fwd_std")).alias("fwd_std"),
        "fwd_max", "fwd_min", r(F.col("fwd_iat_mean"), 3).alias("fwd_iat_mean"), r(F.col("fwd_iat_std"), 3).alias("fwd_iat_std"), r(F.col("bwd_iat_mean"), 3).alias("bwd_iat_mean"), r(X.ratio(F.col("bwd_packets"), F.col("fwd_packets"))).alias("down_up"))


@register("D09_flow_vector")
def flow_vector(spark, sf):
    f = flows(spark, sf)
    names = [c for c in f.columns if c not in (*X.FLOW_KEY, "client", "start_ts", "last_ts")]
    return f.select(*X.FLOW_KEY, F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in names]).alias("features"))


@register("D17_iat_combine", f"""WITH {DIRECTED}, a AS (SELECT {K}, count(iat) FILTER (fwd) AS n1, count(iat) FILTER (NOT fwd) AS n2, coalesce(avg(iat) FILTER (fwd), 0) AS m1, coalesce(avg(iat) FILTER (NOT fwd), 0) AS m2,
 coalesce(stddev_samp(iat) FILTER (fwd), 0) AS s1, coalesce(stddev_samp(iat) FILTER (NOT fwd), 0) AS s2 FROM f3 GROUP BY {K})
 SELECT {K}, CASE WHEN n1 + n2 > 0 THEN round((n1 * m1 + n2 * m2) / (n1 + n2), 3) ELSE 0 END AS mean, CASE WHEN n1 + n2 > 0 THEN round(sqrt((n1 * s1 * s1 + n2 * s2 * s2) / (n1 + n2)), 3) ELSE 0 END AS std FROM a""")
def iat_combine(spark, sf):
    a = [F.col(c) for c in ("fwd_iat_count", "bwd_iat_count", "fwd_iat_mean", "bwd_iat_mean", "fwd_iat_std", "bwd_iat_std")]
    return flows(spark, sf).select(*X.FLOW_KEY, F.round(X.weighted_mean(a[0], a[2], a[1], a[3]), 3).alias("mean"), F.round(X.weighted_std(a[0], a[4], a[1], a[5]), 3).alias("std"))


@register("D18_size_combine", f"""WITH {DIRECTED} SELECT {K}, min(size) AS mn, max(size) AS mx, round(sqrt((count(*) FILTER (fwd) * power(coalesce(stddev_samp(size) FILTER (fwd), 0), 2) + count(*) FILTER (NOT fwd) * power(coalesce(stddev_samp(size) FILTER (NOT fwd), 0), 2)) / count(*)), 6) AS std FROM f3 GROUP BY {K}""")
def size_combine(spark, sf):
    std = X.weighted_std(F.col("fwd_packets"), F.col("fwd_std"), F.col("bwd_packets"), F.col("bwd_std"))
    return flows(spark, sf).select(*X.FLOW_KEY, F.least("fwd_min", "bwd_min").alias("mn"), F.greatest("fwd_max", "bwd_max").alias("mx"), F.round(std, 6).alias("std"))


@register("D10_flow_totals", f"WITH {KEYED} SELECT {K}, count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM fl GROUP BY {K}")
def flow_totals(spark, sf):
    return flows(spark, sf).select(*X.FLOW_KEY, "packets", "bytes", (F.unix_micros("last_ts") - F.unix_micros("start_ts")).alias("duration_us"))


def by_day(spark, sf):
    return T.packets(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))


DAY = f"{P}, dp AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM pkt)"
WK = ["src_num", "day"]


@register("D12_min_packets", f"WITH {DAY} SELECT src_num, day, count(*) AS n FROM dp GROUP BY 1, 2 HAVING count(*) >= 10")
def min_packets(spark, sf):
    return by_day(spark, sf).groupBy(*WK).agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")


@register("D13_entropy", f"WITH {DAY}, c AS (SELECT src_num, day, dst_port, count(*) AS c FROM dp GROUP BY 1, 2, 3), t AS (SELECT src_num, day, sum(c) AS t, sum(c * log2(c)) AS s FROM c GROUP BY 1, 2) SELECT src_num, day, round(log2(t) - s / t, 6) AS entropy FROM t")
def port_entropy(spark, sf):
    return X.entropy(by_day(spark, sf), WK, "dst_port", "e").select(*WK, F.round("e", 6).alias("entropy"))


@register("D14_sequential_ratio", f"WITH {DAY}, d AS (SELECT DISTINCT src_num, day, dst_num FROM dp), s AS (SELECT *, dst_num - lag(dst_num) OVER (PARTITION BY src_num, day ORDER BY dst_num) AS step FROM d) SELECT src_num, day, CASE WHEN count(step) > 0 THEN round(count(*) FILTER (step = 1) / count(step), 6) ELSE 0 END AS ratio FROM s GROUP BY 1, 2")
def sequential_ratio(spark, sf):
    return X.sequential_ratio(by_day(spark, sf), WK, "dst_num", "r").select(*WK, F.round("r", 6).alias("ratio"))


@register("D15_ttl_ratio", f"WITH {P}, s AS (SELECT src_num, ttl - lag(ttl) OVER (PARTITION BY src_num ORDER BY ts, packet_id) AS step FROM pkt) SELECT src_num, round(coalesce(avg(CASE WHEN step = 1 THEN 1.0 ELSE 0.0 END) FILTER (step IS NOT NULL), 0), 6) AS ratio FROM s GROUP BY 1")
def ttl_ratio(spark, sf):
    w = Window.partitionBy("src_num").orderBy("ts", "packet_id")
    s = T.packets(spark, sf).select("src_num", (F.col("ttl") - F.lag("ttl").over(w)).alias("step"))
    return s.groupBy("src_num").agg(F.round(F.coalesce(F.avg((F.col("step") == 1).cast("double")), F.lit(0.0)), 6).alias("ratio"))


@register("D16_population_variance", f"WITH {P} SELECT src_num, round(var_pop(size), 4) AS var FROM pkt GROUP BY 1")
def population_variance(spark, sf):
    return T.packets(spark, sf).groupBy("src_num").agg(F.round(F.var_pop("size"), 4).alias("var"))


@register("D11_window_vector", f"""WITH {DAY},
g AS (SELECT src_num, day, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src_num, day ORDER BY ts, packet_id) AS d FROM dp),
gs AS (SELECT src_num, day, avg(d) AS m, stddev_pop(d) AS s FROM g GROUP BY 1, 2),
pc AS (SELECT src_num, day, dst_port, count(*) AS c FROM dp WHERE dst_port <> 0 GROUP BY 1, 2, 3),
pe AS (SELECT src_num, day, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e, count(*) AS ports FROM pc GROUP BY 1, 2),
a AS (SELECT src_num, day, count(*) AS n, count(DISTINCT dst_num) AS hosts, min(dst_port) FILTER (dst_port <> 0) AS pmin, max(dst_port) AS pmax, count(*) FILTER (proto = 6) AS tcp, count(*) FILTER (proto = 17) AS udp, count(*) FILTER (proto = 1) AS icmp,
  count(*) FILTER (proto = 6 AND flags & 18 = 2) AS syn, count(*) FILTER (proto = 6 AND flags & 18 = 18) AS sa, count(*) FILTER (proto = 6 AND flags & 4 = 4) AS rst, count(*) FILTER (proto = 6 AND flags & 1 = 1) AS fin,
  count(*) FILTER (proto = 6 AND flags = 0) AS nul, count(*) FILTER (proto = 6 AND flags & 41 = 41) AS xmas, count(*) FILTER (proto = 17 AND dst_port = 53) AS dns, count(*) FILTER (proto = 17 AND dst_port = 123) AS ntp, var_pop(ttl) AS tv FROM dp GROUP BY 1, 2)
SELECT a.src_num, a.day, round(least(1.0, coalesce(e, 0) / 16), 6) AS f0, round(least(1.0, coalesce(ports, 0) / 1000), 6) AS f1, round(coalesce(pmin, 0) / 65535, 6) AS f2, round(pmax / 65535, 6) AS f3,
 round(least(1.0, coalesce(m, 0) / 1e6), 6) AS f4, round(least(1.0, coalesce(s, 0) / 1e6), 6) AS f5, round(least(1.0, hosts / 100), 6) AS f8,
 CASE WHEN tcp > 0 THEN round(syn / tcp, 6) ELSE 0 END AS f12, CASE WHEN tcp > 0 THEN round(sa / tcp, 6) ELSE 0 END AS f13, CASE WHEN tcp > 0 THEN round(rst / tcp, 6) ELSE 0 END AS f14, CASE WHEN tcp > 0 THEN round(fin / tcp, 6) ELSE 0 END AS f15,
 CASE WHEN tcp > 0 THEN round(xmas / tcp, 6) ELSE 0 END AS f22, CASE WHEN tcp > 0 THEN round(nul / tcp, 6) ELSE 0 END AS f23, CASE WHEN udp > 0 THEN round(dns / udp, 6) ELSE 0 END AS f28, CASE WHEN udp > 0 THEN round(ntp / udp, 6) ELSE 0 END AS f29,
 round(icmp / n, 6) AS f36, round(least(1.0, tv / 64), 6) AS f42
FROM a JOIN gs USING (src_num, day) LEFT JOIN pe USING (src_num, day)""")
def window_vector(spark, sf):
    p = by_day(spark, sf)
    w = Window.partitionBy(*WK).orderBy("ts", "packet_id")
    p = p.withColumn("d", F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w))
    tcp, udp, dp = F.col("proto") == 6, F.col("proto") == 17, F.col("dst_port")
    a = p.groupBy(*WK).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("dst_num").alias("hosts"), F.min(F.when(dp != 0, dp)).alias("pmin"), F.max(dp).alias("pmax"), F.count_if(tcp).alias("tcp"), F.count_if(udp).alias("udp"), F.count_if(F.col("proto") == 1).alias("icmp"),
        F.count_if(tcp & X.has(X.SYN) & X.none_of(X.ACK)).alias("syn"), F.count_if(tcp & X.has(X.SYN | X.ACK)).alias("sa"), F.count_if(tcp & X.has(X.RST)).alias("rst"), F.count_if(tcp & X.has(X.FIN)).alias("fin"), F.count_if(tcp & (F.col("flags") == 0)).alias("nul"),
        F.count_if(tcp & X.has(41)).alias("xmas"), F.count_if(udp & (dp == 53)).alias("dns"), F.count_if(udp & (dp == 123)).alias("ntp"), F.var_pop("ttl").alias("tv"), F.avg("d").alias("m"), F.stddev_pop("d").alias("s"))
    known = p.filter("dst_port <> 0")
    ports = X.join_all([X.entropy(known, WK, "dst_port", "e"), known.groupBy(*WK).agg(F.count_distinct("dst_port").alias("ports"))], WK)
    z, c = (lambda x: F.coalesce(x, F.lit(0.0))), F.col
    f = {
        "f0": X.cap(z(c("e")) / 16), "f1": X.cap(z(c("ports")) / 1000), "f2": z(c("pmin")) / 65535, "f3": c("pmax") / 65535, "f4": X.cap(z(c("m")) / 1e6), "f5": X.cap(z(c("s")) / 1e6), "f8": X.cap(c("hosts") / 100),
        "f12": X.ratio(c("syn"), c("tcp")), "f13": X.ratio(c("sa"), c("tcp")), "f14": X.ratio(c("rst"), c("tcp")), "f15": X.ratio(c("fin"), c("tcp")), "f22": X.ratio(c("xmas"), c("tcp")), "f23": X.ratio(c("nul"), c("tcp")),
        "f28": X.ratio(c("dns"), c("udp")), "f29": X.ratio(c("ntp"), c("udp")), "f36": c("icmp") / c("n"), "f42": X.cap(c("tv") / 64),
    }
    return a.join(ports, WK, "left").select(*WK, *[F.round(v, 6).alias(k) for k, v in f.items()])


DECIDE = "CASE WHEN f12 > 0.6 AND f13 < 0.15 AND f1 > 0.05 THEN 'syn_scan' WHEN f22 > 0.5 THEN 'xmas_scan' WHEN f23 > 0.5 THEN 'null_scan' WHEN f36 > 0.7 AND f8 < 0.2 THEN 'icmp_flood' WHEN f14 > 0.5 THEN 'rst_storm' WHEN f28 > 0.9 THEN 'dns_abuse' ELSE 'normal' END"


@register("H15_decision_list", f"""WITH {DAY}, a AS (SELECT src_num, day, count(*) AS n, count(DISTINCT dst_num) AS hosts, count(DISTINCT dst_port) FILTER (dst_port <> 0) AS ports, count(*) FILTER (proto = 6) AS tcp, count(*) FILTER (proto = 17) AS udp, count(*) FILTER (proto = 1) AS icmp,
 count(*) FILTER (proto = 6 AND flags & 18 = 2) AS syn, count(*) FILTER (proto = 6 AND flags & 18 = 18) AS sa, count(*) FILTER (proto = 6 AND flags & 4 = 4) AS rst, count(*) FILTER (proto = 6 AND flags = 0) AS nul, count(*) FILTER (proto = 6 AND flags & 41 = 41) AS xmas, count(*) FILTER (proto = 17 AND dst_port = 53) AS dns FROM dp GROUP BY 1, 2),
 v AS (SELECT src_num, day, ports / 1000 AS f1, hosts / 100 AS f8, CASE WHEN tcp > 0 THEN syn / tcp ELSE 0 END AS f12, CASE WHEN tcp > 0 THEN sa / tcp ELSE 0 END AS f13, CASE WHEN tcp > 0 THEN rst / tcp ELSE 0 END AS f14, CASE WHEN tcp > 0 THEN xmas / tcp ELSE 0 END AS f22, CASE WHEN tcp > 0 THEN nul / tcp ELSE 0 END AS f23, CASE WHEN udp > 0 THEN dns / udp ELSE 0 END AS f28, icmp / n AS f36 FROM a)
 SELECT src_num, day, {DECIDE} AS label FROM v""")
def decision_list(spark, sf):
    return window_vector(spark, sf).select(*WK, F.expr(DECIDE).alias("label"))


@register("E02_range_counts", f"""WITH {P} SELECT packet_id, count(*) OVER (PARTITION BY dst_num ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND 1 PRECEDING) AS same_dst,
 count(*) OVER (PARTITION BY src_num ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND 1 PRECEDING) AS same_src, count(*) OVER (PARTITION BY src_num, dst_port ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000 PRECEDING AND 1 PRECEDING) AS same_src_port FROM pkt""")
def range_counts(spark, sf):
    p = T.packets(spark, sf).withColumn("us", F.unix_micros("ts"))
    w = lambda *k: Window.partitionBy(*k).orderBy("us").rangeBetween(-21_600_000_000, -1)
    n = F.count(F.lit(1))
    return p.select("packet_id", n.over(w("dst_num")).alias("same_dst"), n.over(w("src_num")).alias("same_src"), n.over(w("src_num", "dst_port")).alias("same_src_port"))


@register("E04_inter_arrival", f"WITH {P}, g AS (SELECT src_num, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src_num ORDER BY ts, packet_id) AS d FROM pkt) SELECT src_num, round(avg(d), 3) AS mean, round(stddev_pop(d), 3) AS std, round(count(*) FILTER (d < 600000000) / count(d), 6) AS burst FROM g GROUP BY 1 HAVING count(d) > 0")
def inter_arrival(spark, sf):
    w = Window.partitionBy("src_num").orderBy("ts", "packet_id")
    g = T.packets(spark, sf).select("src_num", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)).alias("d"))
    out = g.groupBy("src_num").agg(F.round(F.avg("d"), 3).alias("mean"), F.round(F.stddev_pop("d"), 3).alias("std"), F.round(F.try_divide(F.count_if(F.col("d") < 600_000_000), F.count("d")), 6).alias("burst"), F.count("d").alias("n"))
    return out.filter("n > 0").drop("n")


@register("E05_direction_lag", f"WITH {DIRECTED} SELECT packet_id, fwd, iat FROM f3")
def direction_lag(spark, sf):
    w = Window.partitionBy(*X.FLOW_KEY).orderBy("ts", "packet_id")
    p = X.with_flow_key(T.packets(spark, sf)).withColumn("fwd", F.col("src_num") == F.first("src_num").over(w))
    d = Window.partitionBy(*X.FLOW_KEY, "fwd").orderBy("ts", "packet_id")
    return p.select("packet_id", "fwd", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(d)).alias("iat"))


@register("E06_tcp_states")
def tcp_states(spark, sf):
    p = X.with_flow_key(T.packets(spark, sf)).filter("proto = 6")
    p = X.gap_sessions(p, X.FLOW_KEY, ["ts", "packet_id"], X.flow_timeout_us(3600))
    return X.tcp_state(p, [*X.FLOW_KEY, "session"])


@register("I06_flow_timeouts", f"WITH {KEYED}, g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {K} ORDER BY ts, packet_id) AS gap FROM fl), s AS (SELECT *, sum(CASE WHEN gap > CASE proto WHEN 6 THEN 300 WHEN 17 THEN 180 ELSE 30 END * 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY ts, packet_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT {K}, CAST(session AS BIGINT) AS session, count(*) AS packets FROM s GROUP BY {K}, session")
def flow_timeouts(spark, sf):
    p = X.gap_sessions(X.with_flow_key(T.packets(spark, sf)), X.FLOW_KEY, ["ts", "packet_id"], X.flow_timeout_us(3600))
    return p.groupBy(*X.FLOW_KEY, "session").agg(F.count(F.lit(1)).alias("packets"))


@register("I55_session_windows", f"WITH {T.DETECTIONS}, g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src ORDER BY ts) AS gap FROM det), s AS (SELECT *, sum(CASE WHEN gap >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT src, min(ts) AS start, count(*) AS n FROM s GROUP BY src, session")
def session_windows(spark, sf):
    out = T.detections(spark, sf).groupBy("src", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("src", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@register("D48_session_features", f"""WITH {KEYED}, c AS (SELECT ip_b, {K.replace("ip_b, ", "")}, bool_or(flags & 18 = 16) AS est, bool_or(flags & 4 = 4) AS rst, bool_or(flags & 18 = 2) AND NOT bool_or(flags & 18 = 18) AS half, sum(size) AS bytes FROM fl WHERE proto = 6 GROUP BY {K})
 SELECT ip_b, count(*) AS sessions, round(avg(CAST(est AS INT)), 6) AS established, round(avg(CAST(half AS INT)), 6) AS half_open, round(avg(CAST(rst AS INT)), 6) AS reset, round(avg(bytes) / 10000, 6) AS bytes FROM c GROUP BY 1""")
def session_features(spark, sf):
    p = X.with_flow_key(T.packets(spark, sf)).filter("proto = 6")
    c = p.groupBy(*X.FLOW_KEY).agg(F.bool_or(X.has(X.ACK) & X.none_of(X.SYN)).alias("est"), F.bool_or(X.has(X.RST)).alias("rst"), (F.bool_or(X.has(X.SYN) & X.none_of(X.ACK)) & ~F.bool_or(X.has(X.SYN | X.ACK))).alias("half"), F.sum("size").alias("bytes"))
    share = lambda n: F.round(F.avg(F.col(n).cast("int")), 6)
    return c.groupBy("ip_b").agg(F.count(F.lit(1)).alias("sessions"), share("est").alias("established"), share("half").alias("half_open"), share("rst").alias("reset"), F.round(F.avg("bytes") / 10000, 6).alias("bytes"))


@register("D52_tcp_attack_features", f"WITH {P} SELECT src_num, round(count(*) FILTER (flags & 4 = 4) / count(*), 6) AS rst_rate, round(count(*) FILTER (flags & 18 = 18) / count(*), 6) AS synack_rate, round(count(*) FILTER (flags IN (0, 41)) / count(*), 6) AS anomaly_rate FROM pkt WHERE proto = 6 GROUP BY 1")
def tcp_attack_features(spark, sf):
    n = F.count(F.lit(1))
    return T.packets(spark, sf).filter("proto = 6").groupBy("src_num").agg(F.round(F.count_if(X.has(X.RST)) / n, 6).alias("rst_rate"), F.round(F.count_if(X.has(X.SYN | X.ACK)) / n, 6).alias("synack_rate"), F.round(F.count_if(F.col("flags").isin(0, 41)) / n, 6).alias("anomaly_rate"))


@register("D42_nxdomain_ratio", f"WITH {P} SELECT user_id, count(*) AS queries, round(count(*) FILTER (size < 100) / count(*), 6) AS ratio FROM pkt WHERE 53 IN (src_port, dst_port) GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (size < 100) / count(*) > 0.2")
def nxdomain_ratio(spark, sf):
    q = T.packets(spark, sf).filter("53 IN (src_port, dst_port)").groupBy("user_id").agg(F.count(F.lit(1)).alias("queries"), (F.count_if(F.col("size") < 100) / F.count(F.lit(1))).alias("r"))
    return q.filter("queries >= 3 AND r > 0.2").select("user_id", "queries", F.round("r", 6).alias("ratio"))


@register("I21_port_hopping", f"WITH {P}, d AS (SELECT packet_id, user_id, ts, dst_port FROM pkt), w AS (SELECT packet_id, len(list_distinct(list(dst_port) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW))) AS ports FROM d) SELECT packet_id, ports, ports >= 5 AS hopping FROM w")
def port_hopping(spark, sf):
    p = T.packets(spark, sf).select("packet_id", "user_id", "dst_port", F.unix_micros("ts").alias("us"))
    n = distinct_in_window(p, ["user_id"], "dst_port", 172_800_000_000, "ports")
    return n.select("packet_id", "ports", (F.col("ports") >= 5).alias("hopping"))


@register("I35_synack_reflection", f"WITH {P} SELECT dst_num, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM pkt WHERE flags & 18 = 18 GROUP BY 1, 2 HAVING count(*) >= 2")
def synack_reflection(spark, sf):
    out = T.packets(spark, sf).filter(X.has(X.SYN | X.ACK)).groupBy("dst_num", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return out.select("dst_num", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@register("I61_flow_dns_state", f"WITH {KEYED} SELECT {K}, count(*) FILTER (dst_port = 53) AS queries, count(*) FILTER (src_port = 53) AS responses, count(*) FILTER (src_port = 53 AND size < 100) AS nx FROM fl WHERE 53 IN (port_a, port_b) GROUP BY {K}")
def flow_dns_state(spark, sf):
    p = X.with_flow_key(T.packets(spark, sf)).filter("53 IN (port_a, port_b)")
    return p.groupBy(*X.FLOW_KEY).agg(F.count_if(F.col("dst_port") == 53).alias("queries"), F.count_if(F.col("src_port") == 53).alias("responses"), F.count_if((F.col("src_port") == 53) & (F.col("size") < 100)).alias("nx"))


@register("H53_app_protocol", f"WITH {P} SELECT packet_id, CASE least(src_port, dst_port) WHEN 22 THEN 'ssh' WHEN 53 THEN 'dns' WHEN 80 THEN 'http' WHEN 123 THEN 'ntp' WHEN 443 THEN 'tls' WHEN 445 THEN 'smb' WHEN 1900 THEN 'ssdp' WHEN 3306 THEN 'mysql' WHEN 3389 THEN 'rdp' WHEN 8080 THEN 'http' ELSE 'unknown' END AS app FROM pkt")
def app_protocol(spark, sf):
    names = {22: "ssh", 53: "dns", 80: "http", 123: "ntp", 443: "tls", 445: "smb", 1900: "ssdp", 3306: "mysql", 3389: "rdp", 8080: "http"}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return T.packets(spark, sf).select("packet_id", F.coalesce(table[F.least("src_port", "dst_port")], F.lit("unknown")).alias("app"))


@register("H52_protocol_name", f"WITH {P} SELECT proto, CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE CAST(proto AS VARCHAR) END AS name, count(*) AS n FROM pkt GROUP BY 1")
def protocol_name(spark, sf):
    name = F.when(F.col("proto") == 6, "tcp").when(F.col("proto") == 17, "udp").when(F.col("proto") == 1, "icmp").otherwise(F.col("proto").cast("string"))
    return T.packets(spark, sf).groupBy("proto", name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@register("D11_full_vector")
def full_vector(spark, sf):
    """All 88 features of each source and day with the label of the decision list; tested against a plain loop."""
    v = V.features(by_day(spark, sf), WK)
    return v.select(*WK, "n_all", V.as_array(v).alias("features"), V.decide(v).alias("label"))


#: One second stands for an hour here, so that two minutes hold flows.
WINDOW = 120 * 3_600_000_000
CATEGORY = "CASE " + " ".join(f"WHEN sp IN ({', '.join(map(str, ports))}) THEN {n}" for n, ports in X.PORT_CATEGORIES.items()) + " WHEN sp < 1024 THEN 14 WHEN sp < 49152 THEN 15 ELSE 16 END"
SIDES = ", ".join(f"count(*) FILTER ({w}) AS {n}n, coalesce(sum(size) FILTER ({w}), 0) AS {n}b, min(size) FILTER ({w}) AS {n}mn, max(size) FILTER ({w}) AS {n}mx, coalesce(stddev_samp(size) FILTER ({w}), 0) AS {n}s, count(iat) FILTER ({w}) AS {n}ic, coalesce(avg(iat) FILTER ({w}), 0) AS {n}im, coalesce(stddev_samp(iat) FILTER ({w}), 0) AS {n}is, min(iat) FILTER ({w}) AS {n}imn, max(iat) FILTER ({w}) AS {n}imx" for n, w in (("f", "fwd"), ("b", "NOT fwd")))
FLAGGED = ", ".join(f"count(*) FILTER (flags & {m} = {b}) AS {n}" for n, m, b in (("syn", 18, 2), ("ack", 16, 16), ("fin", 1, 1), ("rst", 4, 4), ("psh", 8, 8), ("urg", 32, 32)))
VECTOR = {
    "duration_ms": "(t1 - t0) // 1000", "protocol_type": "proto", "src_bytes": "fb", "dst_bytes": "bb", "total_packets": "n", "src_packets": "fn", "dst_packets": "bn", "avg_packet_size": "bytes / n", "min_packet_size": "coalesce(least(fmn, bmn), 0)",
    "max_packet_size": "coalesce(greatest(fmx, bmx), 0)", "std_packet_size": "CASE WHEN n > 1 THEN sqrt((fn * fs * fs + bn * bs * bs) / n) ELSE 0 END", "bytes_per_second": "bytes / secs", "packets_per_second": "n / secs", "src_bytes_per_second": "fb / secs",
    "dst_bytes_per_second": "bb / secs", **{f"{k}_count": k for k in ("syn", "ack", "fin", "rst", "psh", "urg")}, **{f"{k}_rate": f"{k} / greatest(syn + ack + fin + rst + psh + urg, 1)" for k in ("syn", "fin", "rst")},
    "iat_mean": "CASE WHEN fic + bic > 0 THEN (fic * fim + bic * bim) / (fic + bic) ELSE 0 END", "iat_std": "CASE WHEN fic + bic > 1 THEN sqrt((fic * fis * fis + bic * bis * bis) / (fic + bic)) ELSE 0 END", "iat_min": "coalesce(least(fimn, bimn), 0)", "iat_max": "coalesce(greatest(fimx, bimx), 0)",
    "fwd_bwd_ratio": "fn / greatest(bn, 1)", "bytes_ratio": "fb / greatest(bb, 1)", "same_dst_count": "sd", "same_src_count": "ss", "same_srv_count": "sv", "diff_srv_count": "ss - sv",
    "is_tcp": "CASE WHEN proto = 6 THEN 1 ELSE 0 END", "is_udp": "CASE WHEN proto = 17 THEN 1 ELSE 0 END", "is_icmp": "CASE WHEN proto = 1 THEN 1 ELSE 0 END", "dst_port_category": CATEGORY, "is_well_known_port": "CASE WHEN sp < 1024 THEN 1 ELSE 0 END",
}
NEAR = f"RANGE BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING"


@register("K01_flow_vector", f"""WITH {DIRECTED}, fl0 AS (SELECT {K}, min(client) AS client, epoch_us(min(ts)) AS t0, epoch_us(max(ts)) AS t1, count(*) AS n, sum(size) AS bytes, {SIDES}, {FLAGGED} FROM f3 GROUP BY {K}),
 fl1 AS (SELECT *, CASE WHEN client = ip_a THEN ip_b ELSE ip_a END AS server, CASE WHEN client = ip_a THEN port_b ELSE port_a END AS sp, greatest((t1 - t0) / 1e6, 0.001::DOUBLE) AS secs FROM fl0),
 fl2 AS (SELECT *, count(*) OVER (PARTITION BY server ORDER BY t0 {NEAR}) AS sd, count(*) OVER (PARTITION BY client ORDER BY t0 {NEAR}) AS ss, count(*) OVER (PARTITION BY client, sp ORDER BY t0 {NEAR}) AS sv FROM fl1)
 SELECT {K}, {", ".join(f"round(CAST({e} AS DOUBLE), 4) AS {n}" for n, e in VECTOR.items())} FROM fl2""")
def flow_vector(spark, sf):
    v = X.flow_vector(flows(spark, sf), WINDOW)
    return v.select(*X.FLOW_KEY, *[F.round(c, 4).alias(c) for c in v.columns if c not in X.FLOW_KEY])
