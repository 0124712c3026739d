"""Ordered states against plain loops, and streams against their batch form."""

import random
from collections import defaultdict

import pytest

from vigilframe.operators import flows, stateful
from vigilframe.plans import registry


def rows(seed=0, n=400):
    r = random.Random(seed)
    return [(i, f"s{r.randint(0, 4)}", r.randint(0, 2000), r.randint(0, 9), r.random() * 100) for i in range(n)]


@pytest.mark.parametrize("state", [
    lambda: stateful.FindTime(3, 40), lambda: stateful.FixedWindow(3, 60), lambda: stateful.RuleThreshold("limit", 2, 50), lambda: stateful.RuleThreshold("threshold", 3, 50),
    lambda: stateful.RuleThreshold("both", 2, 50), lambda: stateful.FirstSeen(30), lambda: stateful.DistinctPorts(4, 80), lambda: stateful.SlidingLimit(2, 60)])
def test_fold_equals_a_loop(spark, state):
    data = rows()
    df = spark.createDataFrame(data, "event_id long, src string, us long, port int, value double").repartition(3)
    got = {r["event_id"]: r["fired"] for r in stateful.fold(df, ["src"], state).collect()}
    by = defaultdict(state)
    for i, s, us, port, v in sorted(data, key=lambda x: (x[2], x[0])):
        assert got[i] == by[s]({"event_id": i, "src": s, "us": us, "port": port, "value": v})


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("window", [0, 1, 40, 10_000])
@pytest.mark.parametrize("batch", ["10000", "7"])
def test_anchored_windows_equal_a_loop(spark, closed, window, batch):
    """Across small Arrow batches, two keys of which one is null, equal times and windows of no length."""
    r = random.Random(window)
    data = [(i, r.choice(["a", None, "b"]), r.choice([1, None]), r.randint(0, 300)) for i in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(data, "event_id long, x string, y int, us long").repartition(3)
        got = {q["event_id"]: (q["__window"], q["__place"], q["__opened"]) for q in stateful.anchored_windows(df, ["x", "y"], ["us", "event_id"], window, closed).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    state, want = {}, {}
    for i, x, y, us in sorted(data, key=lambda d: (d[3], d[0])):
        n, place, opened = state.get((x, y), (-1, 0, None))
        if opened is None or (us > opened + window if closed else us >= opened + window):
            n, place, opened = n + 1, 0, us
        want[i] = (n, place, opened)
        state[x, y] = (n, place + 1, opened)
    assert got == want


def test_find_time_resets_on_fire():
    s = stateful.FindTime(3, 100)
    assert [s({"us": t}) for t in (0, 1, 2, 3, 4, 5)] == [False, False, True, False, False, True]


def test_third_event_aggregates_and_sources_stay_apart(spark):
    df = spark.createDataFrame([(i, s, i * 1_000_000) for i, s in enumerate("aababba")], "event_id long, src string, us long")
    got = {(r["src"], r["place"]) for r in stateful.gap_buckets(df, ["src"], 60_000_000).collect()}
    assert got == {("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1), ("b", 2), ("b", 3)}


def test_repeat_is_suppressed_inside_the_window():
    s = stateful.FirstSeen(60)
    assert [s({"us": t}) for t in (0, 10, 59, 60, 61)] == [True, False, False, True, False]


def test_both_directions_make_one_flow(spark):
    p = spark.createDataFrame([(1, "2024-01-01 00:00:00", 10, 20, 1000, 80, 6, 2, 10), (2, "2024-01-01 00:00:01", 20, 10, 80, 1000, 6, 18, 30)], "packet_id long, ts string, src_num long, dst_num long, src_port int, dst_port int, proto int, flags int, size int")
    p = p.withColumn("ts", p["ts"].cast("timestamp"))
    got = flows.flow_aggregate(p, flows.FLOW_KEY).collect()
    assert len(got) == 1 and (got[0]["fwd_packets"], got[0]["bwd_packets"], got[0]["client"], got[0]["syn_count"], got[0]["syn_ack_count"]) == (1, 1, 10, 1, 1)


def test_tcp_handshake_and_reset(spark):
    seq = {"ok": [2, 18, 16, 24], "closed": [2, 18, 16, 17, 17], "rst": [2, 4], "mid": [16]}
    data = [(k, i, f, i) for k, fl in seq.items() for i, f in enumerate(fl)]
    df = spark.createDataFrame(data, "k string, packet_id long, flags int, t int").withColumnRenamed("t", "ts")
    assert {r["k"]: r["state"] for r in flows.tcp_state(df, ["k"]).collect()} == {"ok": "established", "closed": "closed", "rst": "reset", "mid": "established"}


@pytest.mark.parametrize(("values", "want"), [([1, 1, 1, 1], 0.0), ([1, 2, 3, 4], 2.0)])
def test_entropy(spark, values, want):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v int")
    assert flows.entropy(df, ["k"], "v", "e").first()["e"] == pytest.approx(want)


def test_sequential_addresses(spark):
    df = spark.createDataFrame([("k", 3232235777 + i) for i in range(4)], "k string, v long")
    assert flows.sequential_ratio(df, ["k"], "v", "r").first()["r"] == 1.0


def test_stream_bans_equal_batch_bans(spark, sf):
    q = registry.queries()
    key = lambda df: sorted((r["src"], r["event_id"]) for r in df.collect())
    assert key(q["I01_stream_bans"](spark, sf)) == key(q["I01_find_time_ban"](spark, sf))


def test_other_queries_run(spark, sf):
    names = set(registry.queries()) - set(registry.oracle_sql())
    for n in sorted(names):
        assert registry.queries()[n](spark, sf).count() > 0 or n in {"I02_port_scan_ban"}, n


def test_null_keys_and_large_numbers(spark):
    from vigilframe.operators import stateful as S

    big = (1 << 60) + 1
    rows = [(None, i, big if i % 2 else None, i) for i in range(6)] + [(5, 0, big, 9)]
    df = spark.createDataFrame(rows, "k long, us long, v long, event_id long")
    got = S.fold(df, ["k"], lambda: S.FixedWindow(3, 100)).collect()
    assert sum(r["fired"] for r in got if r["k"] is None) == 4
    assert sorted(r["v"] for r in got if r["v"] is not None) == [big] * 4
