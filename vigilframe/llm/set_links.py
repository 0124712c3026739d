"""Exact Jaccard links between shingle sets of candidate groups, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, shuffle_parts


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words; of all words where there are fewer."""
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[i : i + width])) for i in range(n)), dtype=np.uint64, count=n))


def jaccard_links(sets: list[np.ndarray], at_least: tuple[int, int], maybe: Callable[[int, np.ndarray], np.ndarray] | None = None, at_once: int = 1 << 19) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph that joins sets of Jaccard similarity at_least[0] / at_least[1] or more, in whole numbers.

    Breadth first: a visited set takes every unvisited one in reach, so no pair list is made. Sets too large or too small
    for each other are passed over, as are those for which maybe(x, others) is false.
    """
    num, den = at_least
    size = np.array([len(s) for s in sets], dtype=np.int64)
    rest, out = np.arange(len(sets)), []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            some = rest[(den * np.minimum(size[rest], size[x])) >= num * np.maximum(size[rest], size[x])]
            if maybe is not None and len(some):
                some = some[maybe(x, some)]
            found, start = [], 0
            while start < len(some):
                end = start + max(1, int(np.searchsorted(np.cumsum(size[some[start:]]), at_once)))
                part = some[start:end]
                flat = np.concatenate([sets[i] for i in part])
                at = np.searchsorted(sets[x], flat)
                hit = sets[x][np.minimum(at, size[x] - 1)] == flat
                shared = np.bincount(np.repeat(np.arange(len(part)), size[part])[hit], minlength=len(part))
                found += part[den * shared >= num * (size[part] + size[x] - shared)].tolist()
                start = end
            if found:
                out += [(x, y) for y in found]
                front += found
                rest = rest[~np.isin(rest, found)]
    return out


def _block_links(at_least: tuple[int, int], filtered: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside each block; a key that came twice counts once."""
        for block in runs(batches, ["root", "lo", "hi"]):
            rows = {k: (s, e) for k, s, e in zip(*(block.column(c).to_pylist() for c in ("key", "shingles", "extra")), strict=True)}
            if len(rows) < 2:
                continue
            keys = sorted(rows)
            maybe = filtered([rows[k][1] for k in keys]) if filtered else None
            links = jaccard_links([np.frombuffer(rows[k][0], dtype=np.uint64) for k in keys], at_least, maybe)
            kind = block.schema.field("key").type
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x, _ in links], kind), pa.array([keys[y] for _, y in links], kind)], names=["a", "b"])

    return run


def links_in_groups(sets: DataFrame, at_least: tuple[int, int], block_bytes: int = 16 << 20, filtered: Callable | None = None) -> DataFrame:
    """Links a, b that connect, inside each root of sets(root, key, shingles, extra), what pairs at the similarity or above connect.

    Every pair of a root is covered, whatever the root's size: its keys are dealt to as many parts as its bytes ask for,
    and each pair of parts is one block, so a task holds two parts at most. A root of one part is one block. filtered gets
    the list of a block's `extra` and gives the `maybe` of jaccard_links, None: all pairs are tried.
    """
    parts = shuffle_parts(sets.sparkSession)
    kind = sets.schema["key"].dataType.simpleString()
    size = sets.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles")).alias("bytes")).filter("n > 1")
    size = size.select(F.col("root").alias("root2"), F.greatest(F.lit(1), F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("parts"))
    rows = sets.join(size, sets["root"] == size["root2"]).withColumn("own", F.pmod(F.xxhash64("key", F.lit(3)), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own")))
    rows = rows.withColumn("other", F.explode(others)).select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "key", "shingles", "extra")
    return rows.repartition(parts, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(_block_links(at_least, filtered), f"a {kind}, b {kind}")


def pair_parts(keys: DataFrame, by: str, most: int) -> DataFrame:
    """Each key of keys(key, ...) replaced by one for each pair of its parts: rows are dealt by `by` to parts of about `most`
    rows, and every two rows of a key share one new key at least. Rows are copied once for each other part."""
    size = keys.groupBy("key").agg(F.greatest(F.lit(2), F.ceil(F.count(F.lit(1)) / most)).cast("int").alias("parts")).select((F.col("key") + 1).alias("k1"), "parts")
    rows = keys.join(size, keys["key"] + 1 == size["k1"]).withColumn("own", F.pmod(F.xxhash64(by, F.lit(9)), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("own"))))
    return rows.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).select(*keys.columns)
