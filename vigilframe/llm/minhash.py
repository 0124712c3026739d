"""Near-duplicate groups by b-bit MinHash: bands of minima name candidates, packed low bits estimate, full sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, bound_batches, discard, materialize, pieces, raw_texts, relieve, shuffle_parts
from .components import components
from .set_links import links_in_groups, pair_parts, shingle_set


@dataclass(frozen=True)
class Scheme:
    """How sets become signatures. Similarity at_least[0] / at_least[1] or more is a link.

    hashes minima give bands of `rows` minima each, from the first on; the lowest `bits` (1, 2, 4 or 8) of every minimum are
    packed. A pair at the threshold shares no band with probability (1 - s^rows)^bands, 4e-7 as set here, and has more
    unlike lanes than `unlike_at_most` with probability `miss`.
    """

    at_least: tuple[int, int] = (85, 100)
    hashes: int = 256
    bits: int = 2
    bands: int = 20
    rows: int = 4
    miss: float = 1e-7
    seed: int = 11

    @cached_property
    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.integers(0, 1 << 63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, self.hashes, dtype=np.uint64)

    @cached_property
    def unlike_at_most(self) -> int:
        """The most lanes of two packed signatures that may differ: a pair at the threshold has more with probability `miss`."""
        p = (1 - self.at_least[0] / self.at_least[1]) * (1 - 2.0**-self.bits)
        left = 1.0
        for k in range(self.hashes + 1):
            left -= comb(self.hashes, k) * p**k * (1 - p) ** (self.hashes - k)
            if left <= self.miss:
                return k
        return self.hashes

    def minima(self, shingles: np.ndarray, at_once: int = 256) -> np.ndarray:
        """For each hash function its smallest 32-bit value over the shingles' 64-bit hashes."""
        a, b = self.factors
        out = np.full(self.hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), at_once):
            v = shingles[at : at + at_once, None] * a
            v += b
            v >>= np.uint64(32)
            np.minimum(out, v.min(axis=0), out=out)
        return out

    def pack(self, minima: np.ndarray) -> bytes:
        low = minima & np.uint64((1 << self.bits) - 1)
        lanes = 64 // self.bits
        shift = (np.arange(self.hashes, dtype=np.uint64) % np.uint64(lanes)) * np.uint64(self.bits)
        return np.bitwise_or.reduceat(low << shift, np.arange(0, self.hashes, lanes)).tobytes()

    def band_keys(self, minima: np.ndarray) -> bytes:
        used = minima[: self.bands * self.rows].astype(np.uint32).reshape(self.bands, self.rows)
        return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), i) for i, r in enumerate(used)], dtype=np.uint64).tobytes()

    def unlike(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Lanes in which packed signatures (rows of words) differ, by bit counts."""
        x = many ^ one
        for k in (1, 2, 4):
            if k < self.bits:
                x |= x >> np.uint64(k)
        ones = np.uint64(sum(1 << i for i in range(0, 64, self.bits)))
        return np.bitwise_count(x & ones).sum(axis=1)

    def estimate(self, unlike: np.ndarray) -> np.ndarray:
        """Similarity from unlike lanes, corrected for lanes that are alike by chance, 2^-bits of those of unlike minima."""
        by_chance = 2.0**-self.bits
        return (1 - unlike / self.hashes - by_chance) / (1 - by_chance)

    def words(self, packed: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(packed), dtype=np.uint64).reshape(len(packed), -1)


def _forest(scheme: Scheme, ids: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph that joins signatures of few enough unlike lanes. Breadth first, no pair list."""
    out, rest = [], np.arange(len(ids))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = scheme.unlike(words[x], words[rest]) <= scheme.unlike_at_most
            if near.any():
                out += [(int(ids[x]), int(ids[y])) for y in rest[near]]
                front += rest[near].tolist()
                rest = rest[~near]
    return out


def _bucket_links(scheme: Scheme, hot: int | None, at_once: int = 1 << 16):
    """Streams rows (key, uid, sig) in order of key; a run of more than `hot` rows is not kept, its key is passed on with `large`."""

    def links(key: np.ndarray, uid: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.diff(key)) + 1
        start, end = np.r_[0, cut], np.r_[cut, len(key)]
        n = end - start
        two = start[n == 2]
        two = two[scheme.unlike(words[two], words[two + 1]) <= scheme.unlike_at_most] if len(two) else two
        a, b = uid[two].tolist(), uid[two + 1].tolist()
        for s, e in zip(start[n > 2].tolist(), end[n > 2].tolist(), strict=True):
            if hot is None or e - s <= hot:
                for x, y in _forest(scheme, uid[s:e], words[s:e]):
                    a.append(x)
                    b.append(y)
        big = key[start[n > hot]].tolist() if hot is not None else []
        if a or big:
            yield pa.RecordBatch.from_arrays([pa.array(a + big, pa.int64()), pa.array(b + big, pa.int64()), pa.array([False] * len(a) + [True] * len(big))], names=["a", "b", "large"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, skip = [], 0, None
        join = lambda: [np.concatenate(x) for x in zip(*held, strict=True)]
        for batch in batches:
            key, uid, words = batch.column(0).to_numpy(), batch.column(1).to_numpy(), scheme.words(batch.column(2).to_pylist()) if batch.num_rows else None
            if skip is not None:
                keep = key != skip
                key, uid, words = key[keep], uid[keep], words[keep] if words is not None else None
            if not len(key):
                continue
            held.append((key, uid, words))
            n += len(key)
            if n < at_once:
                continue
            key, uid, words = join()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from links(key[:last], uid[:last], words[:last])
            held, n = [(key[last:], uid[last:], words[last:])], n - last
            if hot is not None and n > hot:
                skip, held, n = key[-1], [], 0
                yield pa.RecordBatch.from_arrays([pa.array([int(skip)], pa.int64()), pa.array([int(skip)], pa.int64()), pa.array([True])], names=["a", "b", "large"])
        if n:
            yield from links(*join())

    return run


def _finer(scheme: Scheme, tables: int = 64, lanes: int = 12):
    """Keys of hot buckets' rows made finer by `tables` draws of `lanes` lanes of the packed signature."""
    rng = np.random.default_rng(scheme.seed + 1)
    draws = [np.sort(rng.choice(scheme.hashes, lanes, replace=False)) for _ in range(tables)]
    each = 64 // scheme.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                words = scheme.words(part.column("sig").to_pylist())
                lane = (words[:, np.arange(scheme.hashes) // each] >> ((np.arange(scheme.hashes) % each) * scheme.bits).astype(np.uint64)) & np.uint64((1 << scheme.bits) - 1)
                old = part.column("key").to_pylist()
                keys = [xxhash.xxh3_64_intdigest(old[i].to_bytes(8, "little", signed=True) + lane[i, d].astype(np.uint8).tobytes(), t) for i in range(part.num_rows) for t, d in enumerate(draws)]
                wide = part.take(pa.array(np.repeat(np.arange(part.num_rows), tables)))
                yield wide.set_column(wide.schema.get_field_index("key"), "key", pa.array(np.array(keys, dtype=np.uint64).view(np.int64)))

    return run


def candidate_links(sets: DataFrame, scheme: Scheme, hot: int = 4096, rows_per_task: int = 500_000) -> DataFrame:
    """Links a, b between uid of sets(uid, n, bands, sig) that share a band and have few enough unlike lanes, as spanning forests.

    Tasks read their buckets in order, one in memory at a time. A bucket of more than `hot` rows is named instead and
    split: first by size class (a pair at the threshold lies in one or in neighbouring classes), then by draws of
    signature lanes, at last into pairs of parts of `hot` rows, each a task's block, so no pair is left out there.
    """
    spark = sets.sparkSession
    tasks = max(shuffle_parts(spark), -(-sets.count() * scheme.bands // rows_per_task))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                wide = part.take(pa.array(np.repeat(np.arange(part.num_rows), scheme.bands)))
                keys = np.frombuffer(b"".join(part.column("bands").to_pylist()), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(wide.column(c) for c in ("uid", "sig", "n"))], names=["key", "uid", "sig", "n"])

    keys = sets.select("uid", "n", "bands", "sig").mapInArrow(spread, "key bigint, uid bigint, sig binary, n bigint")
    ratio = np.log(scheme.at_least[1] / scheme.at_least[0])
    found = []
    for level in range(4):
        last = level == 3
        dealt = keys.repartition(tasks, "key").sortWithinPartitions("key")
        out = materialize(dealt.select("key", "uid", "sig").mapInArrow(_bucket_links(scheme, None if last else hot), "a bigint, b bigint, large boolean"))
        found.append(out.filter("NOT large").select("a", "b"))
        large = out.filter("large").select((F.col("a") + 1).alias("k1")).distinct()
        if last or large.isEmpty():
            break
        keys = keys.join(large, keys["key"] + 1 == large["k1"], "left_semi")
        if level == 0:
            size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(ratio) * (1 + 1e-9))).cast("int")
            keys = materialize(keys.withColumn("key", F.explode(F.array(*[F.xxhash64("key", size_class + i) for i in (0, 1)]))))
        elif level == 1:
            keys = materialize(keys.mapInArrow(_finer(scheme), StructType([StructField(f.name, LongType() if f.name != "sig" else f.dataType) for f in keys.schema])))
        else:
            keys = pair_parts(keys, "uid", hot)
    return reduce(DataFrame.unionAll, found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, scheme: Scheme = Scheme(), block_bytes: int = 16 << 20, hot: int = 4096) -> DataFrame:
    """One row per input row: __id, __size (distinct shingles of its text) and __component, the smallest id that links reach.

    Texts are lower-cased A-Z and cut into words at [\\x20\\x09-\\x0D]; a text's set holds its distinct `width`-word
    shingles, all words as one where there are fewer. Sets link at Jaccard similarity scheme.at_least or more, decided on
    whole sets in whole numbers. Equal sets are one row of everything that follows, so copies make no pairs. Bands name
    candidates, packed signatures drop those whose unlike lanes are too many for the threshold, and the groups that the
    rest forms are verified in blocks of bounded size (links_in_groups).

    Texts without words (null, empty, blank) have size 0 and are alone: __component is their own id. Null ids count for no
    minimum: a group of null ids has a null component. Repeated rows stay repeated. Very long texts count whole. An
    empty table gives an empty result. Only id and text are read, so other columns' names do not matter.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    relieve(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    body = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__raw"), F.col(text_col).alias("__text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                out = []
                for t in raw_texts(part, "__text"):
                    words = t.translate(LOWER).split()
                    if not words:
                        out.append((0, None, None, None))
                        continue
                    own = shingle_set(words, width)
                    low = scheme.minima(own)
                    out.append((len(own), xxhash.xxh3_128_hexdigest(own.tobytes()), scheme.band_keys(low), scheme.pack(low)))
                n, key, bands, sig = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__raw"), pa.array(n, pa.int64()), pa.array(key, pa.string()), pa.array(bands, pa.binary()), pa.array(sig, pa.binary())], names=["__id", "__raw", "n", "key", "bands", "sig"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                sets = [shingle_set(t.translate(LOWER).split(), width).tobytes() for t in raw_texts(part, "__text")]
                yield pa.RecordBatch.from_arrays([part.column("root"), part.column("uid"), pa.array(sets, pa.binary()), part.column("sig")], names=["root", "key", "shingles", "extra"])

    def filtered(packed: list[bytes]):
        words = scheme.words(packed)
        return lambda x, others: scheme.unlike(words[x], words[others]) <= scheme.unlike_at_most

    rows = materialize(body.mapInArrow(signed, f"__id {id_type}, __raw bigint, n bigint, key string, bands binary, sig binary"))
    worded = rows.filter("key IS NOT NULL")
    each = worded.groupBy("key", "__id", "__raw").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("__id").isNull().alias("z"), "__id", "__raw", "times")).alias("m")
    texts = each.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), first)
    texts = materialize(texts.select("key", "n", "bands", "sig", F.col("m.__id").alias("i"), F.col("m.__raw").alias("r"), F.col("m.times").alias("times"), F.monotonically_increasing_id().alias("uid")))

    roots = materialize(components(candidate_links(texts, scheme, hot)).select(F.col("node").alias("uid2"), "root"))
    maybe = texts.join(roots, texts["uid"] == roots["uid2"]).select("uid", "root", "sig", "i", "r", "times")
    bodies = body.join(maybe, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__raw") == F.col("r")))
    repeated = not maybe.filter("times > 1").isEmpty()
    sets = bodies.select("root", "uid", "sig", "__text").mapInArrow(sets_of, "root bigint, key bigint, shingles binary, extra binary")
    if repeated:  # rows that agree in id and text gave one set each
        sets = sets.groupBy("root", "key").agg(F.first("shingles").alias("shingles"), F.first("extra").alias("extra"))
    sets = materialize(sets)
    groups = materialize(components(links_in_groups(sets, scheme.at_least, block_bytes, filtered)).select(F.col("node").alias("uid2"), "root"))
    discard(sets, roots)

    rooted = texts.join(groups, texts["uid"] == groups["uid2"], "left").select("key", "i", F.coalesce("root", "uid").alias("root"))
    # a component may hold a third of all texts: its minimum is combined before the shuffle, and its rows may be split
    least = rooted.groupBy("root").agg(F.min("i").alias("__component")).select(F.concat(F.lit("r"), F.col("root").cast("string")).alias("k"), "__component")
    named = rooted.withColumn("k", F.concat(F.lit("r"), F.col("root").cast("string"))).join(least, "k").select(F.concat(F.lit("k"), "key").alias("key2"), "__component")
    out = rows.select("__id", "n", "key", F.concat(F.lit("k"), "key").alias("key1")).join(named, F.col("key1") == F.col("key2"), "left")
    return out.select("__id", F.col("n").alias("__size"), F.when(F.col("key").isNull(), F.col("__id")).otherwise(F.col("__component")).alias("__component"))
