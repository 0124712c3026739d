"""The window vector against a plain loop over packets."""

import math
import random
from collections import Counter, defaultdict

import pytest

from vigilframe.operators import window_vector as V


def ent(values):
    n = Counter(values)
    t = sum(n.values())
    return -sum(k / t * math.log2(k / t) for k in n.values()) if t else 0.0


def gaps(rows):
    return [b["us"] - a["us"] for a, b in zip(rows, rows[1:], strict=False)]


def mean(x):
    return sum(x) / len(x) if x else 0.0


def pstd(x):
    return math.sqrt(mean([(v - mean(x)) ** 2 for v in x]))


def seq(values):
    v = sorted(set(values))
    return mean([float(b - a == 1) for a, b in zip(v, v[1:], strict=False)])


def regular(rows, least):
    g = gaps(rows)
    return 1 - min(1, pstd(g) / mean(g)) if len(rows) >= least and mean(g) > 0 else 0.0


def naive(rows):
    rows = sorted(rows, key=lambda r: (r["us"], r["packet_id"]))
    f = [0.0] * 88
    of = lambda k: [r for r in rows if r["proto"] == k]
    tcp, udp, icmp, n = of(6), of(17), of(1), len(rows)
    dur = (rows[-1]["us"] - rows[0]["us"]) / 1e6
    share = lambda part, whole: len(part) / len(whole) if whole else 0.0
    rate = lambda x: x / dur if dur > 0 else 0.0
    cap = lambda x: min(1.0, x)
    dp = [r["dst_port"] for r in rows if r["dst_port"]]
    f[0], f[1], f[2], f[3] = cap(ent(dp) / 16), cap(len(set(dp)) / 1000), min(dp, default=0) / 65535, max(dp, default=0) / 65535
    g = gaps(rows)
    if n >= 2:
        f[4], f[5], f[6], f[7] = cap(mean(g) / 1e6), cap(pstd(g) / 1e6), mean([float(x < 1000) for x in g]), cap(dur / 60)
    dst = [r["dst_num"] for r in rows]
    f[8], f[9], f[10], f[11] = cap(len(set(dst)) / 100), cap(ent(dst) / 8), seq(dst), cap(len({d >> 8 for d in dst}) / 50)
    is_ = lambda bits: [r for r in tcp if r["flags"] & bits == bits]
    syn, sa = [r for r in tcp if r["flags"] & 18 == 2], is_(18)
    f[12], f[13], f[14], f[15] = share(syn, tcp), share(sa, tcp), share(is_(4), tcp), share(is_(1), tcp)
    ports = defaultdict(list)
    for r in tcp:
        ports[r["dst_port"]].append(r["flags"])
    state = [(any(x & 18 == 2 for x in v), any(x & 18 == 18 for x in v), any(x & 18 == 16 for x in v), any(x & 4 for x in v)) for v in ports.values()]
    f[16] = f[18] = mean([float(s and a and k) for s, a, k, _ in state])
    f[17], f[19] = mean([float(s and not a and not k) for s, a, k, _ in state]), mean([float(s and r and not a) for s, a, _, r in state])
    f[20], f[21], f[22], f[23] = share([r for r in tcp if r["dst_port"] in V.AUTH_PORTS], tcp), max((len(v) for v in ports.values()), default=0) / max(1, len(tcp)), share(is_(41), tcp), share([r for r in tcp if r["flags"] == 0], tcp)
    un = [r for r in icmp if (r["icmp_type"], r["icmp_code"]) == (3, 3)]
    if udp:
        f[24], f[25], f[26], f[27], f[35] = 1 - cap(len(un) / len(udp)), len(un) / len(udp), cap(pstd([r["size"] for r in udp]) / 1000), share([r for r in udp if not r["size"]], udp), 1.0
        for i, p in ((28, 53), (29, 123), (30, 1900)):
            f[i] = share([r for r in udp if r["dst_port"] == p], udp)
        f[31] = 1 - f[28] - f[29] - f[30]
    t = lambda *k: [r for r in icmp if r["icmp_type"] in k]
    for i, k in ((36, (8, 128)), (37, (0, 129)), (38, (3, 1)), (39, (11, 3))):
        f[i] = share(t(*k), icmp)
    ttl = [r["ttl"] for r in rows]
    f[40], f[41], f[42], f[43] = seq([r["dst_num"] for r in t(8, 128)]), mean([float(b - a == 1) for a, b in zip(ttl, ttl[1:], strict=False)]), cap(pstd(ttl) ** 2 / 64), ent([r["icmp_code"] for r in icmp]) / 8
    if len(icmp) >= 2:
        f[44], f[45], f[46], f[47] = regular(icmp, 2), cap(rate(len(icmp)) / 1000), cap(rate(len({r["dst_num"] for r in icmp})) / 100), len(t(0, 129)) / len(t(8, 128)) if t(8, 128) else 0.0
    if dur >= 0.001:
        pps = n / dur
        f[64], f[65], f[66] = cap(pps / 1e5), cap(rate(sum(r["size"] for r in rows)) / 125e6), cap(rate(len(syn)) / 1e4)
        f[67] = 1 - min(1, len(sa) / len(syn)) if tcp and pps > 1000 and syn else 0.0
        f[68] = cap((0.4 * f[64] + 0.3 * f[66] + 0.3 * f[67]) * f[12])
        if len(udp) / n > 0.5:
            f[69] = (0.5 * cap(rate(len(udp)) / 1e5) + 0.5 * cap(rate(sum(r["size"] for r in udp)) / 125e6)) * len(udp) / n
        f[70] = cap(rate(len(t(8, 128))) / 50_000) * (1 if len({r["dst_num"] for r in icmp}) <= 3 else 0.5)
        f[71] = 0.4 * f[66] + 0.6 * f[67] if f[66] > 0.05 and f[67] > 0.5 else 0.0
    if icmp:
        s = [r["size"] for r in icmp]
        f[80] = cap(max(0, mean(s) - 64) / 192)
        f[81] = cap(pstd(s) / 256) if mean(s) > 64 and pstd(s) ** 2 > 100 else 0.0
        q = len(t(8, 128)) + len(t(0, 129))
        f[82], f[83] = 2 * abs(len(t(8, 128)) / q - 0.5) if q else 0.0, regular(icmp, 3)
    return f


def packets(spark, rows):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "k string, packet_id long, us long, dst_num long, src_port int, dst_port int, proto int, flags int, size int, ttl int, icmp_type int, icmp_code int")
    return df.selectExpr("*", "timestamp_micros(us) AS ts").drop("us")


def test_equals_a_plain_loop(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        proto = r.choice([6, 6, 6, 17, 1])
        icmp = proto == 1
        rows.append({"k": r.choice("abc"), "packet_id": i, "us": r.randint(0, 200_000) * (1 if r.random() < 0.9 else 300), "dst_num": 3232235777 + r.randint(0, 9), "src_port": 0 if icmp else 40000, "dst_port": 0 if icmp else r.choice([22, 53, 80, 123, 1900, 445, 5000 + i % 50]), "proto": proto, "flags": r.choice([2, 2, 18, 16, 4, 17, 0, 41]) if proto == 6 else 0, "size": r.choice([0, 40, 100, 700]), "ttl": r.choice([60, 61, 62]), "icmp_type": r.choice([8, 0, 3, 11]) if icmp else None, "icmp_code": r.choice([0, 3]) if icmp else None})
    rows += [{**rows[0], "k": "one", "packet_id": 9000}]
    got = {x["k"]: x for x in V.features(packets(spark, rows), ["k"]).collect()}
    for k in ("a", "b", "c", "one"):
        want = naive([x for x in rows if x["k"] == k])
        for i in range(88):
            assert got[k][f"f{i}"] == pytest.approx(want[i], abs=1e-6), (k, i)


def flood(n, gap_us, flags):
    return [{"k": "a", "packet_id": i, "us": i * gap_us, "dst_num": 1, "src_port": 1024 + i % 100, "dst_port": 80, "proto": 6, "flags": flags, "size": 0, "ttl": 64, "icmp_type": None, "icmp_code": None} for i in range(n)]


def test_rates_and_labels(spark):
    slow = V.features(packets(spark, flood(100, 10_000, 16)), ["k"]).first()
    assert slow["f64"] < 0.01
    fast = V.features(packets(spark, flood(1000, 100, 2)), ["k"])
    row = fast.withColumn("label", V.decide(fast)).first()
    assert row["f68"] > 0 and row["label"] == "syn_flood"
    assert V.features(packets(spark, flood(5, 1, 41)), ["k"]).select(V.decide(None).alias("x")).first()["x"] == "xmas_scan"
    assert V.features(packets(spark, flood(1, 1, 2)).limit(0), ["k"]).count() == 0
