"""Mined hard negatives against a loop over all pairs; brackets of scores on their own."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigilframe.llm import hard_negatives as hn


def plain(rows, every=10, positives=5, negatives=5):
    """rows: (id, vector, label). The same in loops."""
    part = []
    for uid, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((uid, i, [math.floor(256 * x) for x in v], label))
    out = []
    for uid, i, v, label in part:
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), math.inf if j is None else j, u, k) for u, j, w, k in part if u != uid)
        for ps, j, _, _ in [s for s in scored if s[3] == label][:positives]:
            near = [s for s in scored if s[3] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:negatives]
            out += [(i, j, rank, n[1], -ps, -n[0]) for rank, n in enumerate(near, 1)]
    return sorted(tuple(None if x == math.inf else x for x in r) for r in out if True)


def mined(spark, rows, every=10, **kw):
    df = spark.createDataFrame(rows, "vec_id long, e array<float>, label int").withColumns({c: F.lit("own") for c in ("id", "v", "sq", "uid", "far", "__anchor")})
    return [tuple(r) for r in hn.hard_negatives(hn.quantised(df, "vec_id", "e", F.col("label")), F.col("id") % every == 0, **kw).collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize(("block_rows", "chunk_rows", "pivots"), [(4096, 2048, 16), (20, 3, 4), (7, 1, 1)])
def test_matches_all_pairs(spark, block_rows, chunk_rows, pivots):
    rng = np.random.default_rng(block_rows)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(300):
        v = centres[rng.integers(6)] + rng.normal(size=12) * 0.3 if i % 3 else rng.normal(size=12)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.choice([0, 0, 0, 1, 2, 3]))))
    same = rows[30][1]
    rows += [(i, same, i % 2) for i in range(300, 340)]  # one very common vector
    rows += [(20, rows[20][1], rows[20][2]), (20, rows[20][1], 1 - min(rows[20][2], 1)), (None, same, 0), (400, [0.0] * 12, 0), (410, [-0.001] * 12, 1)]
    rows += [(420, None, 1), (430, [float("nan")] + [0.0] * 11, 1), (440, [float("inf")] * 12, 1), (450, [None] + [1.0] * 11, 1), (460, same, None), (470, [1.0], 2), (480, [], 1), (490, [3e30] * 12, 1)]
    mine = order(mined(spark, rows, block_rows=block_rows, chunk_rows=chunk_rows, pivots=pivots))
    assert mine == order(plain([r for r in rows if r[0] != 490])) and len(mine) > 300


def test_scores_beyond_doubles_are_exact(spark):
    """Squared lengths above 2^53: whole-number products, no rounding."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 2e6 + 1e6], int(i % 3)) for i in range(120)]
    assert order(mined(spark, rows)) == order(plain(rows))


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0)]) == mined(spark, [(10, [1.0], 0)]) == mined(spark, [(10, [1.0], 0), (11, [1.0], 1)]) == []
    assert mined(spark, [(10, [1.0], 0), (11, [1.0], 0), (12, [0.9], 1)]) == [(10, 11, 1, 12, 65536, 230 * 256)]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 6), st.sampled_from([1.0, 1e3, 1e9]))
def test_brackets_hold_the_score(seed, pivots, size):
    rng = np.random.default_rng(seed)
    x, a = np.floor(rng.normal(size=(30, 5)) * size), np.floor(rng.normal(size=(8, 5)) * size)
    bound = float((x * x).sum(axis=1).max()) + 1
    extra = np.sqrt(bound - (x * x).sum(axis=1))
    table = hn.Pivots(np.c_[x, extra][:pivots], bound)
    far, mine = table.rows(x), table.anchors(a)
    nearest = np.abs(mine[:, None, :] - far[None, :, :]).max(axis=2)
    farthest = (mine[:, None, :] + far[None, :, :]).min(axis=2)
    low, high = table.bracket((a * a).sum(axis=1)[:, None], nearest, farthest)
    assert ((low <= a @ x.T) & (a @ x.T <= high)).all()
