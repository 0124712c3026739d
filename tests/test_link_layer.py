"""Link-layer detectors on literal cases."""

import pytest

from vigilframe.operators import link_layer as N
from vigilframe.plans import registry

S = N.SECOND


def test_handshake_needs_all_four_messages_and_starts_over():
    h = N.Handshake(30 * S)
    row = lambda t, m, p=False: {"us": t * S, "msg": m, "pmkid": p}
    assert [h(row(*r)) for r in [(0, 1), (1, 2), (2, 3), (3, 4), (4, 4), (5, 1, True), (6, 1, True)]] == [None, None, None, "HandshakeCapture", None, "PmkidCapture", None]
    assert [h(row(*r)) for r in [(40, 1), (41, 2), (42, 3), (80, 4)]] == [None] * 4  # too late


def test_reinstallation_by_counter_nonce_and_repetition():
    row = lambda t, m, c, n: {"us": t * S, "msg": m, "counter": c, "nonce": n}
    k = N.Reinstall(60 * S, 3)
    assert [k(row(*r)) for r in [(0, 3, 5, "a"), (1, 3, 5, "b"), (2, 3, 6, "a"), (3, 2, 1, "a"), (4, 3, 7, "c")]] == [False, True, True, False, False]
    k = N.Reinstall(60 * S, 3)
    assert [k(row(t, 3, t + 1, str(t))) for t in range(4)] == [False, False, True, False]


def frames(spark, rows, columns="event_id long, us long, k string, name string"):
    return spark.createDataFrame(rows, columns)


def test_flood_of_names_counts_each_once_per_window(spark):
    rows = [(i, i * S, "a", f"n{i % 4}") for i in range(10)] + [(10, 70 * S, "a", "n9"), (11, 71 * S, "a", ""), (12, 72 * S, "a", None)]
    got = {r["event_id"]: r["seen"] for r in N.distinct_flood(frames(spark, rows), ["k"], "name", 3).collect()}
    assert got == {i: 4 for i in range(3, 10)}


def test_rate_flood_has_a_least_age(spark):
    rows = [(0, 0, "a", ""), (1, 1000, "a", ""), (2, S, "a", ""), (3, 9 * S, "b", "")]
    assert {r["event_id"]: r["rate"] for r in N.rate_flood(frames(spark, rows), ["k"]).collect()} == {1: pytest.approx(20.0)}


def test_nobody_is_a_stranger_where_nobody_is_known(spark):
    f = frames(spark, [(1, 0, "a", ""), (2, 0, "b", ""), (3, 0, None, "")])
    known = spark.createDataFrame([("a",)], "server string")
    assert sorted(r["event_id"] for r in N.strangers(f, "k", known, "server").collect()) == [2, 3]
    assert N.strangers(f, "k", known.limit(0), "server").count() == 0


def test_a_known_origin_may_take_a_prefix_over_from_an_unknown_one(spark):
    rows = [(1, 1, "p", True, 9), (2, 2, "p", True, 1), (3, 3, "p", True, 2), (4, 4, "p", True, 9), (5, 5, "q", False, 1), (6, 6, "q", True, 1)]
    u = frames(spark, rows, "event_id long, us long, prefix string, announced boolean, origin long")
    assert sorted(r["event_id"] for r in N.origin_alerts(u, [1, 2]).collect()) == [1, 3, 4]
    assert {r["prefix"]: r["changes"] for r in N.flapping(u, 10, limit=1).collect()} == {"p": 4, "q": 1}


def test_queries_find_something(spark, sf):
    names = [n for n, f in registry.queries().items() if f.__module__.endswith("plans.link_layer")]
    big = sf.replace("0.001", "0.01")
    assert not [n for n in names if registry.queries()[n](spark, big).count() == 0]
