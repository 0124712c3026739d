"""Packets to bidirectional flows, per-source windows and their features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOW_KEY = ["ip_a", "port_a", "ip_b", "port_b", "proto"]
FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32


def has(bits: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(bits)) == bits


def none_of(bits: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(bits)) == 0


def with_flow_key(packets: DataFrame) -> DataFrame:
    """The 5-tuple with the smaller (address, port) first, so both directions meet in one key."""
    a, b = F.struct(F.col("src_num").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_num").alias("ip"), F.col("dst_port").alias("port"))
    low, high = F.least(a, b), F.greatest(a, b)
    return packets.withColumns({"ip_a": low["ip"], "port_a": low["port"], "ip_b": high["ip"], "port_b": high["port"]})


def gap_sessions(df: DataFrame, keys: list[str], order: list[str], gap_us: Column | int) -> DataFrame:
    """session: number of gaps longer than gap_us before each row of a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    return df.withColumn("session", F.sum(F.when(gap > gap_us, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def flow_timeout_us(hour_scale: int = 1) -> Column:
    """Idle time that ends a flow, by protocol: TCP 300 s, UDP 180 s, ICMP 30 s, times a scale for sparse data."""
    s = F.when(F.col("proto") == 6, 300).when(F.col("proto") == 17, 180).otherwise(30)
    return s.cast("long") * hour_scale * 1_000_000


def flow_aggregate(packets: DataFrame, keys: list[str]) -> DataFrame:
    """One row per flow: direction counters, sizes, inter-arrival statistics by direction, flag counters.

    The first packet's sender is the client; forward means from the client. Inter-arrival times are lags inside a
    direction. One exchange on the key serves the windows and the aggregation.
    """
    p = with_flow_key(packets) if "ip_a" in keys and "ip_a" not in packets.columns else packets
    w = Window.partitionBy(*keys).orderBy("ts", "packet_id")
    p = p.withColumn("client", F.first(F.col("src_num")).over(w))
    p = p.withColumn("fwd", F.col("src_num") == F.col("client"))
    d = Window.partitionBy(*keys, "fwd").orderBy("ts", "packet_id")
    p = p.withColumn("iat", F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(d))
    out = [F.min("client").alias("client"), F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes")]
    for name, side in (("fwd", F.col("fwd")), ("bwd", ~F.col("fwd"))):
        size, iat = F.when(side, F.col("size")), F.when(side, F.col("iat"))
        out += [
            F.count(size).alias(f"{name}_packets"), F.coalesce(F.sum(size), F.lit(0)).alias(f"{name}_bytes"), F.max(size).alias(f"{name}_max"), F.min(size).alias(f"{name}_min"), F.avg(size).alias(f"{name}_mean"),
            F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias(f"{name}_std"), F.avg(iat).alias(f"{name}_iat_mean"), F.coalesce(F.stddev_samp(iat), F.lit(0.0)).alias(f"{name}_iat_std"), F.min(iat).alias(f"{name}_iat_min"), F.max(iat).alias(f"{name}_iat_max"), F.count(iat).alias(f"{name}_iat_count"),
        ]
    out += [F.count_if(has(b)).alias(n) for n, b in (("fin_count", FIN), ("rst_count", RST), ("psh_count", PSH), ("ack_count", ACK), ("urg_count", URG))]
    out += [F.count_if(has(SYN) & none_of(ACK)).alias("syn_count"), F.count_if(has(SYN | ACK)).alias("syn_ack_count")]
    return p.groupBy(*keys).agg(*out)


def weighted_std(n1: Column, s1: Column, n2: Column, s2: Column) -> Column:
    """Standard deviation of two parts from their variances alone; the shift between their means is left out."""
    n = n1 + n2
    return F.when(n > 0, F.sqrt((n1 * s1 * s1 + n2 * s2 * s2) / n)).otherwise(0.0)


def weighted_mean(n1: Column, m1: Column, n2: Column, m2: Column) -> Column:
    return F.when(n1 + n2 > 0, (n1 * F.coalesce(m1, F.lit(0.0)) + n2 * F.coalesce(m2, F.lit(0.0))) / (n1 + n2)).otherwise(0.0)


def tcp_state(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Connection state of each key by an ordered fold over its packets.

    The packets of one key are gathered: a connection is bounded by its timeout, so callers key by session.
    """
    step = F.struct("ts", "packet_id", "flags")
    gathered = packets.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("p"))

    def fold(state: Column, p: Column) -> Column:
        f = p["flags"]
        bit = lambda b: f.bitwiseAND(F.lit(b)) != 0
        return (
            F.when(bit(RST), "reset").when(state == "reset", "reset")
            .when(bit(SYN) & ~bit(ACK), F.when(state.isin("new", "closed"), "syn_sent").otherwise(state))
            .when(bit(SYN) & bit(ACK), F.when(state.isin("new", "syn_sent"), "syn_received").otherwise(state))
            .when(bit(FIN), F.when(state == "fin_wait", "closed").when(state == "closed", "closed").otherwise("fin_wait"))
            .when(bit(ACK), F.when(state.isin("new", "syn_sent", "syn_received"), "established").otherwise(state))
            .otherwise(state)
        )

    return gathered.select(*keys, F.aggregate("p", F.lit("new"), fold).alias("state"))


#: The TCP states of directed_tcp_state, by number.
TCP_STATES = ("new", "syn_sent", "syn_received", "established", "fin_wait_1", "fin_wait_2", "closing", "time_wait", "closed", "reset")


def directed_tcp_state(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Connection state of each key by an ordered fold over its packets and their direction; forward is the first packet's.

    A connection that begins without a SYN was picked up midway and is established. Only an answering SYN-ACK and then a
    forward ACK complete a handshake. Reset and closed connections stay so. The packets of one key are gathered as small
    numbers: a connection is bounded by its timeout, so callers key by session.
    """
    w = Window.partitionBy(*keys).orderBy("ts", "packet_id")
    code = F.col("flags") * 2 + (F.col("src_num") == F.first("src_num").over(w)).cast("int")
    step = F.struct("ts", "packet_id", F.col("code"))
    gathered = packets.withColumn("code", code).groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("p"))

    def fold(state: Column, p: Column) -> Column:
        flags, forward = F.shiftright(p["code"], 1), p["code"] % 2 == 1
        bit = lambda b: flags.bitwiseAND(F.lit(b)) != 0
        syn, syn_ack, rst, fin, ack = bit(SYN) & ~bit(ACK), bit(SYN) & bit(ACK), bit(RST), bit(FIN), bit(ACK)

        def on(*cases: tuple[Column, int]) -> Column:
            out = state
            for test, to in reversed(cases):
                out = F.when(test, F.lit(to)).otherwise(out)
            return out

        moves = {
            0: F.when(syn, 1).otherwise(3), 1: on((syn_ack & ~forward, 2), (rst, 9)), 2: on((ack & forward, 3), (rst, 9)), 3: on((rst, 9), (fin, 4)),
            4: on((fin & ack, 7), (fin, 6), (ack, 5), (rst, 9)), 5: on((fin, 7), (rst, 9)), 6: on((ack, 7), (rst, 9)), 7: on((rst, 9)),
        }
        out = state
        for at, to in moves.items():
            out = F.when(state == at, to).otherwise(out)
        return out

    names = F.array(*[F.lit(x) for x in TCP_STATES])
    return gathered.select(*keys, F.element_at(names, F.aggregate("p", F.lit(0), fold) + 1).alias("state"))


def entropy(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Shannon entropy in bits of `value` inside each key: counts first, then one sum."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    total = n.groupBy(*keys).agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return total.select(*keys, (F.log2("t") - F.col("s") / F.col("t")).alias(name))


def sequential_ratio(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Share of steps of exactly one between sorted distinct values."""
    w = Window.partitionBy(*keys).orderBy(value)
    d = df.select(*keys, value).distinct().withColumn("step", F.col(value) - F.lag(value).over(w))
    n = F.count("step")
    return d.groupBy(*keys).agg(F.when(n > 0, F.count_if(F.col("step") == 1) / n).otherwise(0.0).alias(name))


def cap(x: Column, top: float = 1.0) -> Column:
    return F.least(F.lit(float(top)), x)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def join_all(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Aggregates of one key side by side; missing ones become null. All are partitioned by the key already."""
    return reduce(lambda a, b: a.join(b, keys, "left"), parts)


# Category of a server port; other ports are 14 below 1024, 15 below 49152, else 16.
PORT_CATEGORIES = {
    1: (20, 21), 2: (22,), 3: (23,), 4: (25, 465, 587), 5: (53,), 6: (80, 8080), 7: (110, 995), 8: (143, 993), 9: (443, 8443), 10: (3306,), 11: (3389,), 12: (5432,), 13: (6379,),
}


def port_category(port: Column) -> Column:
    out = F.when(port < 1024, 14).when(port < 49152, 15).otherwise(16)
    for number, ports in PORT_CATEGORIES.items():
        out = F.when(port.isin(*ports), number).otherwise(out)
    return out


def counts_before(rows: DataFrame, counts: dict[str, list[str]], us: str, window_us: int) -> DataFrame:
    """rows with a count for each name: the rows of the same keys whose time lies in the window_us before, without its own instant.

    Time is cut into slices as long as the window. A row counts from its time on in its own slice, and in the next one
    until the window has passed, so a count is a running sum of starts and ends: no row looks through its window, and a
    hot key is split by time.
    """
    keys = list(dict.fromkeys(k for some in counts.values() for k in some))
    at, own = F.col(us).cast("long"), F.struct(*rows.columns)
    slot = at - F.pmod(at, F.lit(window_us))
    step = lambda s, t, d, row: F.struct(s.alias("__slot"), t.alias("__at"), F.lit(d).alias("__d"), row.alias("__row"))
    none = F.when(F.lit(False), own)
    steps = rows.select(*keys, F.inline(F.array(step(slot, at, 1, own), step(slot + window_us, at, 1, none), step(slot + window_us, at + window_us, -1, none))))
    for name, some in counts.items():
        w = Window.partitionBy(*some, "__slot").orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumn(name, F.coalesce(F.sum("__d").over(w), F.lit(0)))
    return steps.filter("__row IS NOT NULL").select("__row.*", *counts)


def flow_vector(flows: DataFrame, window_us: int = 120_000_000) -> DataFrame:
    """The 39 features of each flow of flow_aggregate, as columns beside the flow key; times in ms a flow, in us between packets.

    Counts of like connections are over flows that began in the window_us before the flow began, without their own
    instant, of the same server, client, and client and port.
    """
    first = F.col("client") == F.col("ip_a")
    f = flows.withColumns({"server": F.when(first, F.col("ip_b")).otherwise(F.col("ip_a")), "server_port": F.when(first, F.col("port_b")).otherwise(F.col("port_a")), "us": F.unix_micros("start_ts")})
    f = counts_before(f, {"near_server": ["server"], "near_client": ["client"], "near_service": ["client", "server_port"]}, "us", window_us)
    c, zero = F.col, F.lit(0.0)
    total = F.greatest(c("packets"), F.lit(1))
    seconds = F.greatest((F.unix_micros("last_ts") - c("us")) / 1e6, F.lit(0.001))
    flags = F.greatest(c("syn_count") + c("ack_count") + c("fin_count") + c("rst_count") + c("psh_count") + c("urg_count"), F.lit(1))
    both = lambda fn, name: F.coalesce(fn(f"fwd_{name}", f"bwd_{name}"), zero)
    some = c("fwd_iat_count") + c("bwd_iat_count") > 1
    features = {
        "duration_ms": F.floor((F.unix_micros("last_ts") - c("us")) / 1000), "protocol_type": c("proto"), "src_bytes": c("fwd_bytes"), "dst_bytes": c("bwd_bytes"), "total_packets": total, "src_packets": c("fwd_packets"), "dst_packets": c("bwd_packets"),
        "avg_packet_size": c("bytes") / total, "min_packet_size": both(F.least, "min"), "max_packet_size": both(F.greatest, "max"), "std_packet_size": F.when(c("packets") > 1, weighted_std(c("fwd_packets"), c("fwd_std"), c("bwd_packets"), c("bwd_std"))).otherwise(0.0),
        "bytes_per_second": c("bytes") / seconds, "packets_per_second": total / seconds, "src_bytes_per_second": c("fwd_bytes") / seconds, "dst_bytes_per_second": c("bwd_bytes") / seconds,
        **{f"{n}_count": c(f"{n}_count") for n in ("syn", "ack", "fin", "rst", "psh", "urg")}, **{f"{n}_rate": c(f"{n}_count") / flags for n in ("syn", "fin", "rst")},
        "iat_mean": weighted_mean(c("fwd_iat_count"), c("fwd_iat_mean"), c("bwd_iat_count"), c("bwd_iat_mean")), "iat_std": F.when(some, weighted_std(c("fwd_iat_count"), c("fwd_iat_std"), c("bwd_iat_count"), c("bwd_iat_std"))).otherwise(0.0), "iat_min": both(F.least, "iat_min"), "iat_max": both(F.greatest, "iat_max"),
        "fwd_bwd_ratio": c("fwd_packets") / F.greatest(c("bwd_packets"), F.lit(1)), "bytes_ratio": c("fwd_bytes") / F.greatest(c("bwd_bytes"), F.lit(1)),
        "same_dst_count": c("near_server"), "same_src_count": c("near_client"), "same_srv_count": c("near_service"), "diff_srv_count": c("near_client") - c("near_service"),
        "is_tcp": c("proto") == 6, "is_udp": c("proto") == 17, "is_icmp": c("proto") == 1, "dst_port_category": port_category(c("server_port")), "is_well_known_port": c("server_port") < 1024,
    }
    return f.select(*FLOW_KEY, *[x.cast("double").alias(n) for n, x in features.items()])
