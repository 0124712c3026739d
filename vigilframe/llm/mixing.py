"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, floor, gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, packed, shuffle_parts, text_or_empty


def water_fill(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Targets that share sum(sizes) by weight; none is above cap times its size, the excess is shared again."""
    total, target, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            left -= target[i]
            free.discard(i)
    return target


def splitting_tree(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (rows) that each shard (columns) gets; rows sum to `blocks`, columns differ by one at most.

    Every inner node splits its blocks between its halves: how many of each source go left is one multivariate-
    hypergeometric draw, seeded by the node, so the tree can be rebuilt from the root at any time.
    """
    out = np.zeros((len(blocks), shards), dtype=np.int64)
    total = int(blocks.sum())
    load = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    todo = [(0, shards, np.asarray(blocks, dtype=np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            out[:, a] = have
            continue
        mid = (a + b) // 2
        rng = np.random.default_rng([seed, a, b])
        left = rng.multivariate_hypergeometric(have, sum(load[a:mid]), method="marginals") if have.sum() else have * 0
        todo += [(a, mid, left), (mid, b, have - left)]
    return out


@dataclass
class Mix:
    """plan: one row per source. rows: for each input row __id, __size, __words and __target of its source, and __dealt, its copies."""

    plan: list[dict]
    rows: DataFrame
    dealt: Callable[[DataFrame], DataFrame]
    docs: DataFrame
    keys: list[Column]


def _pick(group: pd.DataFrame) -> pd.DataFrame:
    """Greedy fill of a source's remainder from its boundary block: units in permuted order that still fit, then one more if that comes nearer."""
    group = group.sort_values("__u", ignore_index=True)
    left, sizes = float(group["__left"].iloc[0]), group["__unit"].to_numpy()
    taken = np.zeros(len(sizes), dtype=bool)
    for i, s in enumerate(sizes.tolist()):
        if s <= left:
            taken[i] = True
            left -= s
    rest = np.flatnonzero(~taken)
    if len(rest):
        i = rest[np.argmin(sizes[rest])]
        if sizes[i] - left < left:
            taken[i] = True
    return group.loc[taken, ["__s", "__u"]]


def _step(n: int, rng: np.random.Generator) -> int:
    """A factor without a common divisor with n: multiplying by it permutes range(n)."""
    if n < 3:
        return 1
    while True:
        a = int(rng.integers(1, min(n, 1 << 31)))
        if gcd(a, n) == 1:
            return a


def leaf_seeds(shards: int, seed: int) -> list[int]:
    """A number for each leaf of the splitting tree, from the same generators as its inner nodes."""
    return [int(np.random.default_rng([seed, k, k + 1]).integers(0, 1 << 62)) for k in range(shards)]


def mix_sources(
    docs: DataFrame, shards: int = 8, seed: int = 0, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_rows: int = 4096,
) -> Mix:
    """Which copies of each row a mix takes, in which output shard and where in it.

    A source's size is its number of words. Sources in code-point order, null last, weigh `weights` repeating; water_fill
    gives their targets. A source's rows fall into blocks of about block_rows rows by a hash of id, text and seed. Its quota
    is floor(target / size) passes over all its blocks, and as many blocks of one more pass as the rest of the target
    reaches into. splitting_tree deals the blocks of the whole passes among the shards, each of which draws disjoint ranges
    of the source's permuted blocks, and the blocks of the last pass likewise. Of those every shard draws in an order of
    its own, by its leaf's seed, and the shards take turns as their quotas ask for, until the source's target is reached;
    so which blocks a mix takes once more follows from the tree. Of the block in which that happens only those rows are
    taken that fill up the target: a source misses it by less than the smallest row left there. In a shard, copies are
    ordered by a hash.

    Null text counts as empty, null source is a source. Repeated rows (same id, text and source) are taken or left
    together. Very long texts are one row; ties of hashes are taken together. Empty tables and sources without words give
    no copies. The caller's columns are carried as one struct, so none of their names can clash. Texts are counted once;
    the driver holds one row per source.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("~")).alias("__s")
    unit = F.xxhash64(F.col(id_col), F.xxhash64(text), F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.col(source_col).isNull(), F.lit(seed)).alias("__u")
    narrow = materialize(docs.select(F.col(id_col).alias("__id"), source, unit, F.regexp_count(text, F.lit(WORD)).cast("long").alias("__size")))
    found = narrow.groupBy("__s").agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("words")).collect()
    found.sort(key=lambda r: (r["__s"] == "~", r["__s"].encode()))  # "~" alone is null; others start with s
    targets = water_fill([r["words"] for r in found], [weights[i % len(weights)] for i in range(len(found))], cap)
    rng, plan = np.random.default_rng([seed, 7]), []
    for r, t in zip(found, targets, strict=True):
        passes = min(cap, floor(t / r["words"] + 1e-9)) if r["words"] else 0
        left, blocks = max(0.0, t - passes * r["words"]) if r["words"] else 0.0, ceil(r["n"] / block_rows)
        plan.append({"__s": r["__s"], "words": r["words"], "target": t, "passes": passes, "left": left, "blocks": blocks, "quota": passes * blocks, "last": blocks if left else 0, "step": _step(passes * blocks, rng), "last_step": _step(blocks, rng)})
    dealt_to = lambda column, at: splitting_tree(np.array([p[column] for p in plan], dtype=np.int64), shards, at).cumsum(axis=1) if plan else []
    whole, last = dealt_to("quota", seed), dealt_to("last", seed + 1)
    # one row per source: a table of a hundred thousand sources takes some megabytes; beyond, Spark chooses the join
    small_enough = F.broadcast if len(plan) <= 100_000 else lambda df: df
    known = [(p["__s"], p["words"], p["target"], p["passes"], p["left"], p["blocks"], p["quota"], p["step"], p["last"], p["last_step"], [int(x) for x in w], [int(x) for x in e]) for p, w, e in zip(plan, whole, last, strict=True)]
    full = small_enough(spark.createDataFrame(known, "__s string, __words long, __target double, __passes int, __left double, __blocks long, __quota long, __step long, __last long, __last_step long, __ends array<long>, __last_ends array<long>"))
    block = F.pmod(F.xxhash64("__u", F.lit(seed + 1)), F.col("__blocks"))

    # the last pass: one row per block, its shard, and its turn in the shard's own order
    sums = narrow.join(full, "__s").filter("__last > 0").withColumn("__block", block).groupBy("__s", "__block").agg(
        F.sum("__size").alias("w"), *[F.first(c).alias(c) for c in ("__left", "__last", "__last_step", "__last_ends")]
    )
    there = F.pmod(F.col("__block") * F.col("__last_step"), F.col("__last"))
    sums = sums.withColumn("__leaf", F.size(F.filter("__last_ends", lambda e: e <= there))).filter(F.col("__leaf") < shards)
    pool = F.element_at("__last_ends", F.col("__leaf") + 1) - F.when(F.col("__leaf") > 0, F.element_at("__last_ends", F.greatest(F.col("__leaf"), F.lit(1)))).otherwise(0)
    mark = F.xxhash64("__block", F.element_at(F.array(*[F.lit(x) for x in leaf_seeds(shards, seed + 1)]), F.col("__leaf") + 1))
    turn = (F.row_number().over(Window.partitionBy("__s", "__leaf").orderBy(mark, "__block")) - 0.5) / pool
    sums = sums.withColumn("__turn", turn).withColumn("before", F.sum("w").over(Window.partitionBy("__s").orderBy("__turn", "__leaf", "__block")) - F.col("w"))
    fits = F.col("before") + F.col("w") <= F.col("__left")
    drawn = materialize(sums.filter("before < __left").select(F.col("__s").alias("__s1"), F.col("__block").alias("__b1"), "__leaf", fits.alias("__fits"), (F.col("__left") - F.col("before")).alias("__gap")))
    if sum(p["last"] for p in plan) <= 300_000:  # blocks, 50 bytes each, counted on the driver from the sources' rows
        drawn = F.broadcast(drawn)
    at_edge = drawn.filter("NOT __fits")
    units = narrow.join(full, "__s").withColumn("__block", block).join(at_edge, (F.col("__s") == F.col("__s1")) & (F.col("__block") == F.col("__b1")))
    units = units.groupBy("__s", "__u").agg(F.sum("__size").alias("__unit"), F.first("__gap").alias("__left"))
    picked = materialize(units.filter("__unit > 0").groupBy("__s").applyInPandas(_pick, narrow.select("__s", "__u").schema))
    picked = picked.select(F.col("__s").alias("__s2"), F.col("__u").alias("__u2")).distinct()
    if len(plan) * block_rows * 4 <= 4_000_000:  # rows, a bound from the number of sources and the block size; else a shuffle join
        picked = F.broadcast(picked)

    def dealt(rows: DataFrame) -> DataFrame:
        """rows(__s, __u, ...) with what the mix knows of their source, and __dealt."""
        rows = rows.join(full, "__s").withColumn("__block", block)
        rows = rows.join(drawn, (F.col("__s") == F.col("__s1")) & (F.col("__block") == F.col("__b1")), "left")
        rows = rows.join(picked, (F.col("__s") == F.col("__s2")) & (F.col("__u") == F.col("__u2")), "left")

        def place(c):
            v = c.cast("long") * F.col("__blocks") + F.col("__block")
            there = F.pmod(v * F.col("__step"), F.greatest("__quota", F.lit(1)))
            shard = F.size(F.filter("__ends", lambda e: e <= there))  # `shards` where no shard drew that block
            once_more = F.when(F.col("__fits") | F.col("__s2").isNotNull(), F.col("__leaf"))
            shard = F.when(c < F.col("__passes"), shard).otherwise(F.coalesce(once_more, F.lit(shards)))
            return F.struct(shard.alias("__shard"), F.xxhash64("__u", c, F.lit(seed + 2)).alias("__order"))

        copies = F.transform(F.sequence(F.lit(0), F.col("__passes")), place)
        return rows.withColumn("__dealt", F.filter(copies, lambda x: x["__shard"] < shards))

    return Mix(plan, dealt(narrow).select("__id", "__size", "__words", "__target", "__dealt"), dealt, docs, [source, unit])


def draw(mix: Mix) -> DataFrame:
    """The mix itself: __row, the caller's columns as a struct, once per copy with its __shard and __order, the order inside the shard."""
    rows = mix.dealt(mix.docs.select(packed(mix.docs), *mix.keys))
    return rows.select("__row", F.explode("__dealt").alias("__at")).select("__row", "__at.*")


def shuffled(drawn: DataFrame, shards: int) -> DataFrame:
    """What draw() gives, as the mix says: each shard in partitions of its own, one after the other, in __order.

    A shard has as many partitions as the session's shuffle partitions allow, one at least; each holds a range of __order.
    """
    each = -(-shuffle_parts(drawn.sparkSession) // shards)
    part = F.least(F.floor((F.col("__order") / F.lit(2.0**64) + 0.5) * each), F.lit(each - 1)).cast("int")
    return drawn.repartitionById(shards * each, (F.col("__shard") * each + part).cast("int")).sortWithinPartitions("__shard", "__order")
