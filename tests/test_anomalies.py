"""Category, decision, sequences of vectors and watched state against plain loops and literal cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.operators import anomaly as A
from vigilframe.operators import flow_anomaly as X
from vigilframe.operators import watch as W
from vigilframe.plans import anomalies as P


def plain_score(x, base):
    """Score, confidence, top features and category of a vector, in loops over the features."""
    n, mean, std, q1, q3 = base
    names = P.FEATURES
    z = [abs((v - m) / s) if n >= 10 and s >= X.LEAST_STD else 0.0 for v, m, s in zip(x, mean, std, strict=True)]
    if n > 100 and max(z[i] for i in X.QUICK) <= 1.5:
        return 0.0, 1.0, [], None
    far = sorted([(-round(w, 6), i) for i, w in enumerate(z) if round(w, 6) > 3])[:5]
    odd, outliers = [], 0
    for i, v in enumerate(x):
        gap = q3[i] - q1[i]
        if n >= 10 and (v < q1[i] - 1.5 * gap or v > q3[i] + 1.5 * gap):
            outliers += 1
            odd.append((-round((q1[i] - v if v < q1[i] else v - q3[i]) / max(gap, 0.001), 6), i))
    both = sorted([(w, 0, i) for w, i in far] + [(w, 1, i) for w, i in sorted(odd)[:5]])[:5]
    top = [names[i] for _, _, i in both]
    zs, qs = min(sum(z) / len(x) / 6, 1.0), outliers / len(x)
    v = dict(zip(names, x, strict=True))
    category = None
    if top:
        if {"syn_count", "rst_rate", "packets_per_second"} & set(top) and (v["syn_count"] > 100 or v["rst_rate"] > 0.5):
            category = "dos"
        elif {"same_dst_count", "diff_srv_count"} & set(top) and v["diff_srv_count"] > 10:
            category = "probe"
        elif {"bytes_ratio", "src_bytes", "dst_bytes"} & set(top) and v["src_bytes"] > 100_000 and v["src_bytes"] > 10 * v["dst_bytes"]:
            category = "data_exfiltration"
        else:
            category = next((name for some, name in X.PLAIN_CATEGORIES if set(some) & set(top)), "unknown")
    return 0.4 * zs + 0.3 * qs, min(n / 1000, 1.0) * (0.5 + 0.5 * (1 - abs(zs - qs))), top, category


@pytest.mark.parametrize("rows", [7, 60, 400])
def test_scores_and_decisions_match_a_plain_loop(spark, rows):
    rng = np.random.default_rng(rows)
    x = rng.lognormal(1, 1, (rows, 39)).round(3)
    x[:, 35] = 1.0
    for i in range(0, rows, 9):
        x[i, rng.integers(0, 39, 4)] *= 2000
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, " + ", ".join(f"{c} double" for c in P.FEATURES))
    sample = X.training_sample(df, ["k"])
    base = X.learn_baseline(sample, P.FEATURES)
    b = base.first()
    assert np.allclose(b["base_mean"], x.mean(axis=0)) and np.allclose(b["base_q3"], np.quantile(x, 0.75, axis=0)) and np.allclose(b["base_std"], x.std(axis=0, ddof=1))
    scored = X.score_flows(df, base, ["k"], P.FEATURES)
    stats = (b["base_n"], b["base_mean"], b["base_std"], b["base_q1"], b["base_q3"])
    want = {i: plain_score(r.tolist(), stats) for i, r in enumerate(x)}
    for r in scored.collect():
        s, c, top, category = want[r["k"]]
        assert (r["score"], r["confidence"]) == pytest.approx((s, c)) and list(r["top"]) == top and r["category"] == category
    forest = A.IsolationForest(x, trees=30)
    grown = forest.score(x)
    for alert in (0.7, 0.35):
        for r in X.decide(scored, forest, alert=alert).collect():
            s, c, _, category = want[r["k"]]
            both = 0.6 * s + 0.4 * grown[r["k"]]
            assert r["score"] == pytest.approx(both)
            if abs(both - alert) > 1e-9:
                assert r["alert"] == (both >= alert and c >= 0.6 and category != "unknown")
    assert {r["alert"] for r in X.decide(scored, None).collect()} == {False}


def test_categories_in_order(spark):
    """Each category once, by a baseline of zeros and ones and one great feature a row."""
    great = {"dos": {"rst_rate": 50.0}, "probe": {"diff_srv_count": 60.0}, "data_exfiltration": {"src_bytes": 2e5}, "timing_anomaly": {"iat_max": 9.0, "iat_mean": 80.0}, "volume_anomaly": {"total_packets": 70.0}, "protocol_anomaly": {"protocol_type": 70.0}, "unknown": {"urg_count": 70.0}}
    rows = [(name, *[some.get(c, 0.0) for c in P.FEATURES]) for name, some in great.items()] + [("normal", *[0.0] * 39)]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"{c} double" for c in P.FEATURES))
    base = spark.createDataFrame([(50, [0.0] * 39, [1.0] * 39, [0.0] * 39, [0.5] * 39)], "base_n long, base_mean array<double>, base_std array<double>, base_q1 array<double>, base_q3 array<double>")
    got = {r["k"]: r["category"] for r in X.score_flows(df, base, ["k"], P.FEATURES).collect()}
    assert got == {**{k: k for k in great}, "normal": None}


def test_sequences_against_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{int(rng.integers(0, 3))}", int(rng.integers(0, 4000)), i, rng.normal(size=2).round(3).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "src string, us long, event_id long, vector array<double>").repartition(3)
    got = {r["event_id"]: (r["score"], r["limit"], r["anomaly"]) for r in X.temporal_scores(df, "src", 900, 100).collect()}
    seen, scores, want = {}, [], {}
    for src, us, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        own = seen.setdefault(src, [])
        own.append((us, v))
        own[:] = [o for o in own[-100:] if us - o[0] < 900]
        if len(own) >= 5:
            steps = [np.linalg.norm(np.subtract(a[1], b[1])) for a, b in zip(own, own[1:], strict=False)]
            score = 0.5 * np.mean(steps) + 0.5 * np.mean([s > 1 for s in steps])
            scores.append(score)
            limit = np.mean(scores) + 2.5 * np.std(scores, ddof=1) if len(scores) >= 50 else 0.5
            want[i] = (score, limit, score > limit)
    assert got.keys() == want.keys()
    for i, (s, limit, odd) in want.items():
        assert got[i][:2] == pytest.approx((s, limit)) and got[i][2] == odd


def test_discovery_cases(spark):
    frames = [("CDP", "sw1", "sw1", 1, 5, 1), ("CDP", "sw1", "sw1", 2, 5, 2), ("CDP", "sw1", "sw1", 1, 6, 3), ("CDP", "sw1", "sw1", 1, None, 4), ("CDP", "sw1", "sw1", 1, 7, 5), ("CDP", "sw2", "sw2", 9, 1, 6), ("CDP", "sw2", "sw2", 8, 1, 7), ("LLDP", "c1", "sw1", 3, 1, 8), ("LLDP", "c2", "other", 3, 1, 9), ("LLDP", "c2", "other", 3, 2, 10)]
    df = spark.createDataFrame([(*f, i) for i, f in enumerate(frames)], "protocol string, device string, name string, mac long, capabilities int, us long, event_id long")
    known = spark.createDataFrame([("sw1", 1)], "name string, mac long")
    got = {r["event_id"]: list(r["alerts"]) for r in W.discovery_alerts(df, known).collect() if r["alerts"]}
    assert got == {1: ["unexpected_address"], 2: ["capabilities_changed"], 5: ["new_device"], 7: ["unexpected_address"], 8: ["new_device"]}


def test_dns_cases(spark):
    odd = "".join(chr(97 + i % 26) for i in range(70))
    rows = [("a", 60_000_000 * i, odd, 1, 10) for i in range(7)]
    rows += [("b", 1000, f"n{i}", 1, 10) for i in range(102)]
    rows += [("c", 60_000_000 * i, "x", 16, 600 if i in (2, 12) else 10) for i in range(23)]
    rows += [("d", 0, "a" * 70, 1, 10), ("d", 1, odd[:63], 1, 10)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "src string, us long, name string, type int, answer long, event_id long")
    got = {r["event_id"]: (r["finding"], r["severity"], r["ban"]) for r in W.dns_channel(df, "src").collect() if r["finding"]}
    low, high, medium = ("high_entropy", "low", False), ("covert_channel", "high", True), "medium"
    want = {**{i: low for i in range(5)}, 5: high, 6: high, 107: ("rate_limit", medium, False), 108: ("rate_limit", medium, False), 111: ("txt_abuse", medium, False), 121: ("txt_abuse", medium, True), 129: ("txt_abuse", medium, True), 130: ("txt_abuse", medium, True), 131: ("txt_abuse", medium, True)}
    assert got == want
    assert df.limit(1).select(W.name_entropy(F.lit("aabbccdd"))).first()[0] == pytest.approx(2.0)


def test_smb_and_smtp_state(spark):
    messages = [("tree_connect", 1, "\\\\srv\\ADMIN$"), ("tree_connect", 2, "data"), ("tree_disconnect", 1, None), ("pipe", 7, "\\pipe\\SVCCTL"), ("pipe", 7, "\\pipe\\chat"), ("tree_connect", 1, "c$"), ("tree_connect", 1, "print$")]
    messages += [("open", i, f"x{i}.Locky") for i in range(6)] + [("auth_failure", None, None)] * 5
    df = spark.createDataFrame([("s", i, *m) for i, m in enumerate(messages)], "s string, k int, op string, id long, name string")
    got = [(r["lateral"], r["ransomware"], r["brute_force"]) for r in W.smb_state(df, ["s"], ["k"]).orderBy("k").collect()]
    assert [g[0] for g in got[:7]] == [True, True, False, True, False, True, False]
    assert [g[1] for g in got] == [False] * 12 + [True] * 6 and [g[2] for g in got] == [False] * 17 + [True]
    ops = ["mail", "rcpt", "rcpt", "done", "rset", "rcpt", "mail", "rcpt", "done"]
    rows = W.smtp_volume(spark.createDataFrame([("f", i, o) for i, o in enumerate(ops)], "f string, k int, op string"), ["f"], ["k"], 2, 10).orderBy("k").collect()
    assert [(r["transactions"], r["recipients"], r["in_mail"], r["high_volume"]) for r in rows] == [(0, 0, 0, False), (0, 1, 1, False), (0, 2, 2, False), (1, 2, 2, False), (1, 2, 0, False), (1, 3, 1, False), (1, 3, 0, False), (1, 4, 1, False), (2, 4, 1, True)]


def test_only_the_head_of_the_sample_is_sorted(spark):
    """Rows whose hash begins beyond the last one wanted are dropped before the sort, and the sample is the same."""
    df = spark.range(6000).selectExpr("id AS k", "id % 7 AS g", "double(id) AS v").unionAll(spark.sql("SELECT NULL, 1L, 0D"))
    mark = F.md5(F.concat_ws("|", F.col("k").cast("string"), F.col("g").cast("string")).cast("binary"))
    order = [tuple(r) for r in df.orderBy(mark, "k", "g").collect()]
    for most in (0, 1, 37, 500, 6000, 6001, 9000):
        got = X.training_sample(df, ["k", "g"], most)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, order[:most]))
    plan = X.training_sample(df, ["k", "g"], 37)._jdf.queryExecution().analyzed().toString()
    assert plan.index("Sort") < plan.index("Filter")


def test_both_quartiles_from_one_set_of_counts(spark):
    plan = X.learn_baseline(spark.range(10).selectExpr("double(id) AS a"), ["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert "0.25" in plan and plan.count("0.75") == plan.count("0.25,0.75")
