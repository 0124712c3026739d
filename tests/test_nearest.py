"""Exact nearest vectors in cells: every right row is scored, whatever the number of blocks, and none goes to the driver."""

import numpy as np
import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.operators import lookups
from vigilframe.plans import registry

SCHEMA = "id long, label int, v array<float>"


def cosines(a, b):
    n = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.divide(a @ b.T, n, out=np.zeros_like(n), where=n > 0)


@pytest.mark.parametrize("block,chunk", [(512, 4096), (3, 7)])
def test_nearest_matches_brute_force(spark, block, chunk):
    v = np.random.default_rng(1).integers(-3, 4, (60, 3)).astype(np.float32)  # ties and zero vectors occur
    e = spark.createDataFrame([(i, i % 4, [float(x) for x in r]) for i, r in enumerate(v)], SCHEMA)
    right = e.filter("id % 2 = 0").withColumnRenamed("id", "rid")
    for k in (1, 5):
        got = {}
        for r in lookups.nearest(e, right, k, "id", "rid", "v", carry=("label",), block=block, chunk=chunk).orderBy("id", "rank").collect():
            assert r["label"] == r["rid"] % 4
            got.setdefault(r["id"], []).append(round(r["score"], 9))
        c = cosines(v.astype(float), v[::2].astype(float))
        for i in range(len(v)):
            want = sorted((c[i, j] for j in range(30) if 2 * j != i), reverse=True)[:k]
            assert got[i] == pytest.approx(want)
    assert lookups.nearest(e, right.limit(0), 1, "id", "rid", "v").count() == lookups.nearest(e.limit(0), right, 1, "id", "rid", "v").count() == 0


def test_later_signatures_are_scored(spark, tmp_path):
    """With more than 10,000 signatures the best of the last vector is the last signature."""
    n = 50 * 10_001
    spark.range(0, n + 1, 50).selectExpr("id AS vec_id", "CAST(id % 3 AS INT) AS label", f"IF(id = {n}, array(-1F, 0F), array(1F, 0F)) AS embedding").unionAll(spark.sql(f"SELECT {n + 1}L, 0, array(-1F, 0F)")).write.parquet(f"{tmp_path}/embeddings.parquet")
    last = spark.read.parquet(f"{tmp_path}/embeddings.parquet").filter(f"vec_id = {n + 1}")
    got = registry.queries()["C22_vector_signatures"]
    original = lookups.nearest
    try:
        lookups.nearest = lambda left, *a, **k: original(last, *a, **k)  # one left row: the signatures are what is tested
        assert [tuple(r) for r in got(spark, str(tmp_path)).collect()] == [(n + 1, n, n % 3, 1.0)]
    finally:
        lookups.nearest = original


@pytest.mark.parametrize("name", ["C22_vector_signatures", "F07_knn", "F08_rag_top_k"])
def test_no_vectors_on_the_driver(spark, sf, name, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: pytest.fail("collected"))
    assert isinstance(registry.queries()[name](spark, sf), DataFrame)


@pytest.mark.parametrize("name", ["C24_rag_search_all", "C25_rag_filtered_all"])
def test_every_query_is_searched(spark, sf, name):
    got = registry.queries()[name](spark, sf).groupBy("q_id").count().collect()
    assert {r["q_id"] for r in got} == set(range(0, 500, 50)) and max(r["count"] for r in got) <= 20


def test_odd_vectors_score_as_the_expression_does(spark):
    """Null vectors, nulls in them, other lengths, zeros, NaN and many equal vectors; ties by the smaller id."""
    rng = np.random.default_rng(2)
    v = [[float(x) for x in r] for r in rng.integers(-2, 3, (30, 3))] + [[1.0, 1.0, 1.0]] * 12 + [None, [], [1.0], [0.0, 0.0, 0.0], [None, 1.0, 1.0], [float("nan"), 1.0, 1.0], [2.0, 0.5], [0.5, 2.0]]
    e = spark.createDataFrame([(i, i % 4, x) for i, x in enumerate(v)], SCHEMA)
    right = e.filter("id % 3 <> 1").withColumnRenamed("id", "rid")
    pairs = e.select("id", "v").crossJoin(right.withColumnRenamed("v", "q")).withColumn("score", lookups.cosine(F.col("v"), F.col("q")))
    for own in (True, False):
        order = Window.partitionBy("id").orderBy(F.desc("score"), "rid")
        some = pairs if own else pairs.filter("id <> rid")
        want = some.withColumn("rank", F.row_number().over(order)).filter("rank <= 6").select("id", "rid", "score", "rank", "label")
        got = lookups.nearest(e, right, 6, "id", "rid", "v", carry=("label",), own=own, block=11, chunk=9).select(*want.columns)
        mine, theirs = (set(map(str, map(tuple, x.collect()))) for x in (got, want))
        assert sorted(mine - theirs) == sorted(theirs - mine) == []


def test_pairs_are_scored_as_matrices(spark):
    """No interpreted expression runs for each pair of vectors."""
    e = spark.createDataFrame([(i, 0, [1.0, float(i)]) for i in range(700)], SCHEMA)
    plan = lookups.nearest(e, e.withColumnRenamed("id", "rid"), 2, "id", "rid", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "lambda" not in plan
