"""Statistical scores, baselines, votes and calibration, as expressions over columns and arrays."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (x - mean) / std).otherwise(0.0)


def minmax(x: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (x - low) / (high - low)).otherwise(0.0)


def robust(x: Column, median: Column, iqr: Column) -> Column:
    return F.when(iqr > 0, (x - median) / iqr).otherwise(0.0)


def iqr_outlier(x: Column, q1: Column, q3: Column, factor: float = 1.5) -> Column:
    return (x < q1 - factor * (q3 - q1)) | (x > q3 + factor * (q3 - q1))


def profile(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Mean, population deviation, extremes of each column and key, in one pass."""
    out = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        out += [F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*keys).agg(*out)


def at_ranks(df: DataFrame, col: str, ranks: list[int], keep: int = 10_000, accuracy: int = 10_000) -> list[float | None]:
    """The exact values at 0-based ranks of a column in order, nulls left out; null beyond its end. Nothing is sorted on the cluster.

    Minus infinity comes first, then the finite values, infinity, and NaN last. For each rank, approximate percentiles of
    the range that holds it give a narrower range, whose ends and inside are counted exactly; that keeps about 4 rows of
    `accuracy` at each pass and at least leaves out an end, whatever the values' spread. A range of `keep` rows or fewer is
    read, so the driver sees `keep` values a rank at most.
    """
    x = df.select(F.col(col).cast("double").alias("x")).filter("x IS NOT NULL")
    inf, c = F.lit(float("inf")), F.col("x")
    seen = x.agg(F.count_if(c == -inf), F.count_if(~F.isnan(c) & (F.abs(c) != inf)), F.count_if(c == inf), F.count_if(F.isnan(c))).first()
    low, n, high, nan = seen
    x = x.filter(~F.isnan(c) & (F.abs(c) != inf))
    out: list[float | None] = [None] * len(ranks)
    open_: dict[int, tuple[float, float, int, int]] = {}  # exclusive ends, rank and rows inside
    for i, r in enumerate(ranks):
        if low <= r < low + n:
            open_[i] = (float("-inf"), float("inf"), r - low, n)
        elif 0 <= r < low + n + high + nan:
            out[i] = float("-inf") if r < low else float("inf") if r < low + n + high else float("nan")
    within = lambda lo, hi: (c > F.lit(lo)) & (c < F.lit(hi))
    while wide := {i: v for i, v in open_.items() if v[3] > keep}:
        ends = []
        for lo, hi, r, size in wide.values():
            near = [min(1.0, max(0.0, (r + k * (2 * size / accuracy + 1)) / size)) for k in (-1, 1)]
            ends.append(F.percentile_approx(F.when(within(lo, hi), c), F.array(*[F.lit(p) for p in near]), F.lit(accuracy)))
        ends = list(x.agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)]).first())
        counts = [f for (lo, hi, _, _), (a, b) in zip(wide.values(), ends, strict=True) for f in (F.count_if(within(lo, a)), F.count_if(c == F.lit(a)), F.count_if(within(a, b)), F.count_if(c == F.lit(b)))]
        counts = list(x.agg(*[e.alias(f"e{i}") for i, e in enumerate(counts)]).first())
        for k, (i, (lo, hi, r, size)) in enumerate(wide.items()):
            (a, b), (below, at_a, inside, at_b) = ends[k], counts[4 * k : 4 * k + 4]
            if a == b:
                inside = at_b = 0
            parts = [(lo, a, below), (a, a, at_a), (a, b, inside), (b, b, at_b), (b, hi, size - below - at_a - inside - at_b)]
            for start, end, rows in parts:
                if r < rows:
                    break
                r -= rows
            if start == end:
                out[i] = start
                del open_[i]
            else:
                open_[i] = (start, end, r, rows)
    if open_:
        tagged = F.array_compact(F.array(*[F.when(within(lo, hi), F.lit(i)) for i, (lo, hi, _, _) in open_.items()]))
        values: dict[int, list[float]] = {i: [] for i in open_}
        for i, v in x.select(F.explode(tagged), "x").collect():
            values[i].append(v)
        for i, (_, _, r, _) in open_.items():
            out[i] = sorted(values[i])[r]
    return out


def median(df: DataFrame, col: str) -> float | None:
    """The exact median; the mean of the middle two where the count is even, null without values. NaN counts as the greatest."""
    n = df.filter(F.col(col).isNotNull()).count()
    low, high = at_ranks(df, col, [(n - 1) // 2, n // 2]) if n else (None, None)
    return None if low is None else (low + high) / 2


def squash(x: Column, scale: float) -> Column:
    """min(x / scale, 1)."""
    return F.least(x / scale, F.lit(1.0))


def hourly_score(df: DataFrame, ts: str, cols: list[str], least: int = 10) -> DataFrame:
    """df with `score`: the mean absolute z of the columns against the profile of the row's hour of day, 0 without one.

    A column counts where its hour has more than `least` values. The profile has 24 rows at most.
    """
    hour = F.hour(ts)
    stats = [x for c in cols for x in (F.count(c).alias(f"__{c}_n"), F.avg(c).alias(f"__{c}_m"), F.stddev_samp(c).alias(f"__{c}_s"))]
    hours = df.groupBy(hour.alias("__hour")).agg(*stats)
    j = df.withColumn("__hour", hour).join(F.broadcast(hours), "__hour")
    z = [F.when(F.col(f"__{c}_n") > least, F.abs(zscore(F.col(c), F.col(f"__{c}_m"), F.coalesce(F.col(f"__{c}_s"), F.lit(0.0))))) for c in cols]
    known = F.array_compact(F.array(*z))
    score = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)
    return j.withColumn("score", score).select(*df.columns, "score")


def smoothness(df: DataFrame, keys: list[str], order: list[str], vector: str, threshold: float = 0.5) -> DataFrame:
    """score of each key's sequence of vectors: half the mean step between neighbours plus half the share of steps above twice the threshold; 0 for one vector."""
    was = F.lag(vector).over(Window.partitionBy(*keys).orderBy(*order))
    step = F.sqrt(F.aggregate(F.zip_with(vector, was, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))
    d = df.select(*keys, step.alias("d"))
    return d.groupBy(*keys).agg(F.coalesce(0.5 * F.avg("d") + 0.5 * F.avg((F.col("d") > 2 * threshold).cast("double")), F.lit(0.0)).alias("score"))


def l2(a: Column) -> Column:
    n = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda x: F.lit(0.0)))


def vote(scores: list[Column], weights: list[float], how: str, cut: float = 0.5) -> Column:
    """average, weighted, max, min, median, soft, or hard (more than half above the cut)."""
    arr = F.array(*scores)
    n = len(scores)
    if how == "average" or how == "soft":
        return reduce(lambda a, b: a + b, scores) / n
    if how == "weighted":
        return reduce(lambda a, b: a + b, [s * w for s, w in zip(scores, weights, strict=True)]) / sum(weights)
    if how == "max":
        return F.greatest(*scores)
    if how == "min":
        return F.least(*scores)
    if how == "median":
        s = F.sort_array(arr)
        return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2
    if how == "hard":
        return (F.size(F.filter(arr, lambda x: x > cut)) > n / 2).cast("double")
    raise ValueError(how)


def platt(x: np.ndarray, y: np.ndarray, rate: float = 0.01, rounds: int = 1000) -> tuple[float, float]:
    """Slope and intercept of a logistic map by gradient descent on a driver-side sample of bins."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * x + b)))
        a -= rate * float(((p - y) * x).mean())
        b -= rate * float((p - y).mean())
    return a, b


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators over values in score order."""
    blocks: list[list[float]] = []
    for v, k in zip(y.tolist(), w.tolist(), strict=True):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.array([b[0] for b in blocks for _ in range(int(b[2]))])


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 2 * (np.log(n) + 0.5772156649015329) - 2 * (n - 1) / n if n > 1 else 0.0


class IsolationForest:
    """Random splits of a bounded sample, kept as flat arrays; scored in tasks."""

    def __init__(self, x: np.ndarray, trees: int = 50, sample: int = 256, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(x))
        depth = int(np.ceil(np.log2(max(2, self.size))))
        self.trees = [self._flat(self._grow(x[rng.choice(len(x), self.size, replace=True)], depth, rng)) for _ in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
        nodes: list[tuple[int, float, int, int, float]] = []

        def add(rows: np.ndarray, d: int) -> int:
            at = len(nodes)
            nodes.append((-1, 0.0, 0, 0, path_norm(len(rows))))
            span = rows.max(axis=0) - rows.min(axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
            if d < depth and (span > 0).any():
                f = int(rng.choice(np.flatnonzero(span > 0)))
                cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
                left = rows[:, f] < cut
                nodes[at] = (f, cut, add(rows[left], d + 1), add(rows[~left], d + 1), 0.0)
            return at

        add(x, 0)
        return nodes

    @staticmethod
    def _flat(nodes: list[tuple[int, float, int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """feature, cut, children (below, not below) and path length of each node; leaves are their own children."""
        leaf = np.array([f < 0 for f, *_ in nodes])
        feature, cut = np.array([max(f, 0) for f, *_ in nodes]), np.array([c for _, c, *_ in nodes])
        child = np.array([[i, i] if leaf[i] else [lo, hi] for i, (_, _, lo, hi, _) in enumerate(nodes)])
        depth = np.zeros(len(nodes))
        for i in np.flatnonzero(~leaf):  # parents come before their children
            depth[child[i]] = depth[i] + 1
        return feature, cut, child.ravel(), depth + np.array([r for *_, r in nodes]), int(depth.max())

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, child, length, depth in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = child[2 * at + (x[rows, feature[at]] >= cut[at])]
            total += length[at]
        return 2 ** (-(total / len(self.trees)) / max(path_norm(self.size), 1e-9))


class BoostedStumps:
    """One-split trees fitted one after another to what is left of a 0/1 label by squared error; scored as a sum.

    Fitted on a bounded, weighted sample in numpy: `cuts` quantiles a feature are the candidate thresholds, each round
    looks at a random share of rows. A round without a split that helps adds the mean of what is left.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 100, rate: float = 0.1, share: float = 0.8, least: int = 10, cuts: int = 64, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.base, self.rate = float(y.mean()) if len(y) else 0.0, rate
        self.stumps: list[tuple[int, float, float, float]] = []
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, cuts)))[:-1] for c in x.T] if len(x) else []
        at = [np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=False)]  # x <= e[k] where at <= k
        left = y - self.base
        for _ in range(rounds):
            use = np.flatnonzero(rng.random(len(y)) < share)
            if not len(use):
                continue
            r, mean = left[use], float(left[use].mean())
            best = (1e-12, 0, -np.inf, mean, mean)
            for f, e in enumerate(edges) if len(use) >= least else ():
                n = np.cumsum(np.bincount(at[f][use], minlength=len(e) + 1))[:-1]
                s = np.cumsum(np.bincount(at[f][use], r, minlength=len(e) + 1))[:-1]
                m, t = len(use) - n, r.sum() - s
                ok = (n > 0) & (m > 0)
                gain = np.where(ok, s * s / np.maximum(n, 1) + t * t / np.maximum(m, 1) - r.sum() ** 2 / len(use), 0)
                if len(e) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), f, float(e[k]), float(s[k] / n[k]), float(t[k] / m[k]))
            _, f, cut, low, high = best
            self.stumps.append((f, cut, low, high))
            left = left - rate * np.where(x[:, f] <= cut, low, high)

    def score(self, cols: list[Column]) -> Column:
        """The score of a row, within 0 and 1, as one expression: no Python runs on the rows."""
        terms = [F.when(cols[f] <= cut, self.rate * low).otherwise(self.rate * high) if cut > -np.inf else F.lit(self.rate * high) for f, cut, low, high in self.stumps]
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(lambda a, b: a + b, terms, F.lit(self.base))))

    def importance(self) -> dict[int, int]:
        """How many splits each feature made."""
        out: dict[int, int] = {}
        for f, cut, _, _ in self.stumps:
            if cut > -np.inf:
                out[f] = out.get(f, 0) + 1
        return out
