"""Hard-negative mining with a pivot table: stored distances to pivots bracket inner products, survivors are scored exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, runs, shuffle_parts

NO_ID = (1 << 63) - 1  # stands for a null id, behind all others
LIMIT = float(1 << 62)  # of a squared length


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """id, label, v (whole numbers floor(scale * x), x as double) and sq, their squared length, of the rows that take part.

    Rows with a null label, a null vector, or any null or non-finite component do not, nor do those whose squared length
    reaches 2^62: their scores would not fit a long. Shorter vectors count as padded with zeros; an empty one scores 0.
    """
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(finite, F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))).alias("v"))
    rows = rows.filter("label IS NOT NULL AND v IS NOT NULL")
    return rows.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).filter(F.col("sq") < LIMIT)


@dataclass(frozen=True)
class Pivots:
    """Pivots in the augmented space: a row is its vector and sqrt(bound - |v|^2), an anchor its vector and 0.

    Then |anchor - row|^2 = |anchor|^2 + bound - 2 * (inner product), so a bracket of the distance is one of the score.
    """

    points: np.ndarray  # pivots x (dimensions + 1)
    bound: float  # no row's squared length is above it

    def rows(self, v: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        return self._distances(v, np.sqrt(np.maximum(self.bound - (v * v).sum(axis=1), 0)))

    def anchors(self, v: np.ndarray) -> np.ndarray:
        return self._distances(v, np.zeros(len(v)))

    def _distances(self, v: np.ndarray, extra: np.ndarray) -> np.ndarray:
        own = np.c_[v, extra]
        square = (own * own).sum(axis=1)[:, None] + (self.points * self.points).sum(axis=1)[None, :] - 2 * own @ self.points.T
        return np.sqrt(np.maximum(square, 0))

    def slack(self) -> float:
        """More than what rounding makes of a distance's square."""
        return 1e-9 * (self.bound + 1) * 8

    def bracket(self, length: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of anchors of squared length `length` whose distance to a row is from `nearest` to `farthest`."""
        at = length + self.bound
        return (at - farthest**2) / 2 - self.slack(), (at - nearest**2) / 2 + self.slack()


def choose_pivots(rows: DataFrame, dims: int, bound: float, count: int = 16, sample: int = 1024) -> Pivots:
    """Pivots far from each other, from at most `sample` rows of smallest hash: each next one has the greatest distance to those before."""
    some = rows.orderBy(F.xxhash64("id", "label"), "id").limit(sample).select("v").collect()
    v = np.zeros((len(some), dims))
    for i, r in enumerate(some):
        v[i, : len(r["v"])] = r["v"]
    v = np.c_[v, np.sqrt(np.maximum(bound - (v * v).sum(axis=1), 0))]
    taken = [0]
    far = np.full(len(v), np.inf)
    while len(taken) < min(count, len(v)):
        far = np.minimum(far, ((v - v[taken[-1]]) ** 2).sum(axis=1))
        taken.append(int(far.argmax()))
    return Pivots(v[taken], bound)


def _matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    """Packed vectors as a matrix of rows."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=kind).reshape(len(parts), -1)


def _pivot_table(pivots: Pivots, dims: int):
    """Packs each vector, adds its distances to all pivots and its cell, the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("v")
            size = lists.value_lengths().to_numpy()
            v = np.zeros((batch.num_rows, dims), dtype=np.int64)
            v[np.arange(dims)[None, :] < size[:, None]] = lists.flatten().to_numpy()
            far = pivots.rows(v.astype(np.float64))
            cell = far.argmin(axis=1).astype(np.int32)
            packed = lambda m: pa.array([r.tobytes() for r in np.ascontiguousarray(m)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), batch.column("label"), batch.column("anchor"), packed(v), packed(far), pa.array(cell)], names=["uid", "id", "label", "anchor", "v", "far", "cell"])

    return run


def _scores(a: np.ndarray, x: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products: no partial sum exceeds `bound`, so doubles hold them below 2^53."""
    if bound < 2**52:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a @ x.T


def _best(k: int, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> np.ndarray:
    """Places of the k greatest scores, ties by id, then uid."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((uids[some], ids[some], -scores[some]))[:k]]
    return np.lexsort((uids, ids, -scores))[:k]


_FOUND = pa.schema([("a", pa.int64()), ("w", pa.int64()), ("uid", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "a bigint, w bigint, uid bigint, id bigint, score bigint"


def _search(pivots: Pivots, k: int, windows: Callable[[dict], list[tuple[int, int, int]]], alike: bool, slice_rows: int = 128):
    """Scores the anchors of a unit (chunk, block) against its rows.

    windows(anchor) gives (name, least, greatest) of scores looked for; the k best rows of each window leave the task. alike:
    rows of the anchor's own label other than itself, else rows of other labels. An anchor whose windows the whole block's
    distances exclude is passed over, then each row that its own distances exclude; the rest is scored exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, ["chunk", "block"]):
            kind = unit.column("row").to_numpy()
            if kind.all() or not kind.any():
                continue
            rows, asked = unit.filter(pa.array(kind)), unit.filter(pa.array(~kind))
            x, far = _matrix(rows.column("v"), np.int64), _matrix(rows.column("far"))
            uid, ids, label = (rows.column(c).to_numpy() for c in ("uid", "id", "label"))
            inner, outer = far.min(axis=0), far.max(axis=0)
            out: list[tuple] = []
            for at in range(0, asked.num_rows, slice_rows):
                part = asked.slice(at, slice_rows)
                looked = [windows(r) for r in part.select(["scores", "floor"]).to_pylist()]
                least = np.array([min((w[1] for w in ws), default=LIMIT * 2) for ws in looked], dtype=np.float64)
                most = np.array([max((w[2] for w in ws), default=-LIMIT * 2) for ws in looked], dtype=np.float64)
                a = _matrix(part.column("v"), np.int64)
                mine = pivots.anchors(a.astype(np.float64))
                length = (a.astype(np.float64) ** 2).sum(axis=1)
                low, high = pivots.bracket(length, np.maximum(0, np.maximum(mine - outer, inner - mine)).max(axis=1), (mine + outer).min(axis=1))
                live = np.flatnonzero((high >= least) & (low <= most))
                if not len(live):
                    continue
                nearest, farthest = np.zeros((len(live), len(x))), np.full((len(live), len(x)), np.inf)
                for p in range(far.shape[1]):
                    np.maximum(nearest, np.abs(mine[live, p, None] - far[None, :, p]), out=nearest)
                    np.minimum(farthest, mine[live, p, None] + far[None, :, p], out=farthest)
                low, high = pivots.bracket(length[live, None], nearest, farthest)
                own_uid, own_label = part.column("uid").to_numpy()[live], part.column("label").to_numpy()[live]
                keep = (high >= least[live, None]) & (low <= most[live, None]) & ((label[None, :] == own_label[:, None]) == alike)
                keep &= uid[None, :] != own_uid[:, None]
                some = np.flatnonzero(keep.any(axis=0))
                if not len(some):
                    continue
                exact = _scores(a[live], x[some], pivots.bound)
                for i, j in enumerate(live.tolist()):
                    mask = keep[i, some]
                    for name, lo, hi in looked[j]:
                        at_rows = np.flatnonzero(mask & (exact[i] >= lo) & (exact[i] <= hi))
                        if len(at_rows):
                            s, r = exact[i][at_rows], some[at_rows]
                            for b in _best(k, s, ids[r], uid[r]).tolist():
                                out.append((int(own_uid[i]), name, int(uid[r[b]]), int(ids[r[b]]), int(s[b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_FOUND)

    return run


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, pivots: int = 16, block_rows: int = 4096, chunk_rows: int = 2048,
) -> DataFrame:
    """__anchor, __positive, __rank, __negative, __positive_score, __negative_score from the rows of quantised().

    anchor is a condition on `id`. Scores are inner products of whole numbers; higher come first, ties by smaller id, null
    last. An anchor's positives are its first `positives` other rows of the same label; for each, the first `negatives`
    rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are its negatives.
    Rows that repeat an id are rows of their own, and an anchor that is repeated is one twice. Fewer rows give fewer
    results, an empty table none; a negative positive_score has no negatives.

    Pivots are chosen from a bounded sample; they decide the speed, never the result. The pivot table holds each row's
    distances to all pivots; rows lie in blocks of about block_rows by nearest pivot, so that a block's distances are in
    narrow ranges. Anchors meet blocks in units (chunk of anchors, block), dealt by an equi join of both numbers; a unit's
    rows are bounded, whatever label or vector is frequent. Each anchor's own block gives the score that its positives must
    reach. Only the best few of an anchor in a unit leave the task.
    """
    spark = rows.sparkSession
    names = "__anchor bigint, __positive bigint, __rank int, __negative bigint, __positive_score bigint, __negative_score bigint"
    rows = materialize(rows.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "label", "v", "sq", F.coalesce(anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("uid")))
    seen = rows.agg(F.max(F.size("v")), F.max("sq"), F.count_if("anchor")).first()
    if not seen[2]:
        return spark.createDataFrame([], names)
    dims, bound = max(1, seen[0]), seen[1] * (1 + 1e-9) + 1
    found = choose_pivots(rows, dims, bound, pivots)
    table = rows.select("uid", "id", "label", "anchor", "v").mapInArrow(_pivot_table(found, dims), "uid bigint, id bigint, label bigint, anchor boolean, v binary, far binary, cell int")
    table = materialize(table)
    cells = {r[0]: -(-r[1] // block_rows) for r in table.groupBy("cell").count().collect()}  # a row for each pivot
    first, blocks = {}, 0
    for c in sorted(cells):
        first[c], blocks = blocks, blocks + cells[c]
    chunks = -(-seen[2] // chunk_rows)
    of_cell = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("cell"))
    table = table.withColumn("block", (of_cell(first) + F.pmod(F.xxhash64("uid"), of_cell(cells))).cast("int"))
    chunk = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(chunks)).cast("int")
    tasks = max(shuffle_parts(spark), min(blocks * chunks, 20_000))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def units(held: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
        """Rows and anchors of each unit together."""
        columns = ["chunk", "block", "row", "uid", "id", "label", "v", "far", "scores", "floor"]
        held = held.withColumns({"row": F.lit(True), "scores": F.lit(None).cast("array<bigint>"), "floor": F.lit(None).cast("bigint")})
        both = held.select(*columns).unionByName(asked.withColumns({"row": F.lit(False), "far": F.lit(None).cast("binary")}).select(*columns))
        return both.repartition(tasks, *on).sortWithinPartitions(*on)

    anchors = table.filter("anchor").withColumns({"scores": F.lit(None).cast("array<bigint>"), "floor": F.lit(None).cast("bigint")})
    best = lambda df, by, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id", "uid"))).filter(F.col("rank") <= k)
    anything = lambda r: [(0, -(1 << 62), 1 << 62)]
    above = lambda r: [(0, -(1 << 62) if r["floor"] is None else r["floor"], 1 << 62)]
    near = lambda r: [(s, -(-low * s // 100), high * s // 100) for s in set(r["scores"])]

    home = units(table.withColumn("chunk", F.lit(0)), anchors.withColumn("chunk", F.lit(0)), ["chunk", "block"]).mapInArrow(_search(found, positives, anything, True), _FOUND_SQL)
    floors = home.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).select(F.col("a").alias("a2"), F.when(F.col("n") >= positives, F.col("s")).alias("s"))
    start = materialize(anchors.join(floors, anchors["uid"] == floors["a2"], "left").withColumns({"floor": F.col("s"), "chunk": chunk}).select("uid", "id", "label", "v", "scores", "floor", "chunk"))
    everywhere = table.withColumn("chunk", every(chunks))
    hits = units(everywhere, start.withColumn("block", every(blocks)), ["chunk", "block"]).mapInArrow(_search(found, positives, above, True), _FOUND_SQL)
    chosen = materialize(best(hits, ["a"], positives).select("a", F.col("id").alias("positive"), F.col("uid").alias("positive_uid"), F.col("score").alias("ps")))
    scores = chosen.groupBy("a").agg(F.collect_set("ps").alias("s"))  # `positives` numbers at most
    asked = start.join(scores, start["uid"] == scores["a"]).withColumn("scores", F.col("s")).withColumn("block", every(blocks))
    hits = units(everywhere, asked, ["chunk", "block"]).mapInArrow(_search(found, negatives, near, False), _FOUND_SQL)
    mined = best(hits, ["a", "w"], negatives).select(F.col("a").alias("a2"), "w", "rank", F.col("id").alias("negative"), "score")
    out = chosen.join(mined, (F.col("a") == F.col("a2")) & (F.col("ps") == F.col("w")))
    out = out.join(start.select(F.col("uid").alias("a3"), F.col("id").alias("anchor_id")), F.col("a") == F.col("a3"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(F.col("anchor_id").alias("__anchor"), known("positive").alias("__positive"), F.col("rank").alias("__rank"), known("negative").alias("__negative"), F.col("ps").alias("__positive_score"), F.col("score").alias("__negative_score"))
