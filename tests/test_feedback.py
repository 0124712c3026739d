"""Recommended changes by literal cases; a learner that is stopped and started again against a fit of all rows at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.operators import adjust
from vigilframe.streaming import jobs
from vigilframe.streaming import online as O

STATS = "module string, fp_rate double, fn_rate double, top_fp array<struct<name: string, n: long>>, missed array<struct<name: string, n: long>>"


def changes(spark, *rows, **kw):
    return [(r["path"], r["direction"], round(r["amount"], 4), r["current_value"], round(r["new_value"], 4), r["reason"]) for r in adjust.recommend(spark.createDataFrame(list(rows), STATS), **kw).collect()]


def test_thresholds(spark):
    brute, scan = [("SSH Brute force", 4)], [("x", 9), ("Port SCAN", 1)]
    assert changes(spark, ("layer234", 0.07, 0.0, brute, scan)) == [("layer234.brute_force.auth_port_threshold", "increase", 0.02, 0.5, 0.51, "FP rate 7.0% for brute force")]
    assert changes(spark, ("layer234", 0.11, 0.25, scan, brute), strategy="moderate") == [
        ("layer234.scan.signature_threshold", "increase", 0.1, 0.85, 0.935, "FP rate 11.0% for scan detection"),
        ("layer234.brute_force.auth_port_threshold", "decrease", 0.1, 0.5, 0.45, "FN rate 25.0% - missing brute force attacks"),
    ]
    got = changes(spark, ("layer234", 0.2, 0.0, brute + scan, []), strategy="aggressive")
    assert [(c[2], c[4]) for c in got] == [(0.2, 0.6), (0.2, 0.95)]
    assert changes(spark, ("layer234", 0.05, 0.10, brute, scan), ("other", 1.0, 1.0, brute, scan)) == []


def test_patterns_and_classes(spark):
    many = [("SQL Injection", 30), ("b", 11), ("c", 10), ("d", 9)]
    assert [c[0] for c in changes(spark, ("http_detect", 0.06, 0.2, many, [("e f", 6), ("g", 5)]))] == ["http_detect.patterns.sql_injection.enabled", "http_detect.patterns.b.enabled", "http_detect.patterns.e_f"]
    got = changes(spark, ("signatures", 0.11, 0.16, many, [("e", 30), ("f", 21)]))
    assert [(c[1], c[5]) for c in got] == [("decrease", "Missing 51 attacks - review excluded classtypes"), ("increase", "Consider excluding 'SQL Injection' (30 false positives)"), ("increase", "Consider excluding 'b' (11 false positives)")]
    assert changes(spark, ("signatures", 0.1, 0.16, many, [("e", 50)])) == []


def feedback(rng, n, start):
    return [(start + i, (start + i) * 1000, rng.normal(size=3).round(3).tolist(), str(rng.choice(["TP", "FP", "FN", "TN"], p=[0.4, 0.05, 0.05, 0.5])), float(rng.random())) for i in range(n)]


def test_restart_and_equality_with_a_batch_fit(spark, tmp_path):
    """Five files, taken in two runs; the last version is what one fit of all rows gives, and a batch that is written again changes nothing."""
    rng, schema, rows = np.random.default_rng(1), "id long, us long, vector array<double>, outcome string, key double", []
    cadence = O.Cadence(least=60, interval_us=70_000)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for i, n in enumerate((40, 40, 40, 40, 40)):
        some = feedback(rng, n, len(rows))
        rows += some
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        if i in (2, 4):
            O.learn(stream(), str(tmp_path / "m"), 3, capacity=25, cadence=cadence)
    got = {r["version"]: r for r in O.versions(spark, str(tmp_path / "m")).collect()}
    assert [(v, got[v]["n"], got[v]["trained_us"]) for v in sorted(got)] == [(1, 80, 79_000), (2, 160, 159_000)]
    x = np.array([r[2] for r in rows[:160]])
    assert got[2]["mean"] == pytest.approx(x.mean(axis=0).tolist()) and got[2]["m2"] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum(axis=0).tolist())
    whole = O.moments(spark.createDataFrame(rows[:160], schema), 3)
    assert all(whole[o] == got[2][o] == sum(r[3] == o for r in rows[:160]) for o in ("TP", "FP", "FN", "TN"))
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "m/samples/version=2")).collect()} == {r[0] for r in sorted(rows[:160], key=lambda r: (r[4], r[0]))[:25]}

    before = spark.read.parquet(str(tmp_path / "m/state/batch=4")).collect()
    O.learner(str(tmp_path / "m"), 3, 25, cadence)(spark.createDataFrame(rows[160:], schema), 4)
    assert spark.read.parquet(str(tmp_path / "m/state/batch=4")).collect() == before

    scored = O.score(spark.createDataFrame(rows[:5], schema), O.last_model(spark, str(tmp_path / "m"))).orderBy("id").collect()
    z = np.abs((x[:5] - x.mean(axis=0)) / x.std(axis=0, ddof=1)).mean(axis=1)
    assert [r["score"] for r in scored] == pytest.approx(z.tolist()) and {r["version"] for r in scored} == {2}


def test_cadence():
    due = O.Cadence().due
    assert not due(99, 10**12, 1.0, 1.0) and due(100, 3_600_000_000, 0, 0) and not due(100, 3_599_999_999, 0.15, 0.20)
    assert due(100, 0, 0.151, 0) and due(100, 0, 0, 0.201)


def test_empty_batches(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, us long, vector array<double>, outcome string, key double")
    sink = O.learner(str(tmp_path), 3)
    sink(empty, 0)
    sink(empty, 1)
    assert spark.read.parquet(f"{tmp_path}/state/batch=1").first()["n"] == 0


def test_rolling_accuracy_matches_a_loop(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(int(t), str(rng.choice(["a", "b"])), str(rng.choice(["TP", "FP", "FN", "TN"]))) for t in sorted(rng.integers(0, 200_000, 80))]
    spark.createDataFrame(rows, "s long, k string, outcome string").select(F.timestamp_seconds("s").alias("ts"), "k", "outcome").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string, outcome string").parquet(f"{tmp_path}/in")
    jobs.run_once(jobs.rolling_accuracy(stream, ["k"], "24 hours", "6 hours"), f"{tmp_path}/c", jobs.to_table(f"{tmp_path}/out"), mode="complete")
    got = {(r["at"], r["k"]): (r["tp"], r["fp"], r["fn"], r["tn"]) for r in spark.read.parquet(f"{tmp_path}/out").select(F.unix_seconds("at").alias("at"), "k", "tp", "fp", "fn", "tn").collect()}
    want = {}
    for s, k, o in rows:
        for i in range(1, 5):
            at = (s // 21_600 + i) * 21_600
            counts = want.setdefault((at, k), [0, 0, 0, 0])
            counts[["TP", "FP", "FN", "TN"].index(o)] += 1
    assert got == {k: tuple(v) for k, v in want.items()}
