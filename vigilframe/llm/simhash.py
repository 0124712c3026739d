"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, bound_batches, discard, materialize, materialize_seen, pieces, raw_texts, relieve, shuffle_parts
from .components import components
from .set_links import links_in_groups, pair_parts, shingle_set


def bit_majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bit is set where over half of the hashes have it set."""
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 18):
        part = np.ascontiguousarray(hashes[at : at + (1 << 18)])
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(raw: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of UTF-8 text: A-Z lower-cased, repeats counted; 0 for a text without words."""
    words = raw.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    starts, ends, digest = (end - size)[: -width + 1 or None].tolist(), end[width - 1 :].tolist(), xxhash.xxh64_intdigest
    return bit_majority(np.array([digest(line[a:b], seed) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64))


def with_fingerprint(docs: DataFrame, columns: list[str], text_col: str = "text", width: int = 3) -> DataFrame:
    """The given columns of docs and __fp, the fingerprint of the whole text as a signed long."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                prints = np.array([fingerprint(t, width) for t in raw_texts(part, "__text")], dtype=np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(prints)], names=[*columns, "__fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*columns, F.col(text_col).alias("__text")).mapInArrow(run, f"{schema}, __fp bigint")


@lru_cache
def covering_masks(radius: int = 3, bits: int = 64) -> tuple[int, ...]:
    """2^(radius+1) - 1 masks such that any `radius` bits are all outside some mask.

    Bit i gets a non-zero vector of radius+1 bits; mask v keeps the bits whose vector has an odd inner product with v. The
    vectors of the differing bits span at most `radius` dimensions, so a non-zero v is orthogonal to all of them, and that
    mask leaves all those bits out. Which vectors does not matter for that; but each mask should keep about half of the
    bits. All non-zero vectors in turn do that; where there are more of them than bits, the best of some seeded draws is
    taken, by the number of bits that the smallest mask keeps.
    """
    n = (1 << (radius + 1)) - 1
    tries = [[i % n + 1 for i in range(bits)]]
    if n > bits:
        rng = np.random.default_rng(0)
        tries = [(rng.permutation(n)[:bits] + 1).tolist() for _ in range(300)]

    def masks(vector: list[int]) -> tuple[int, ...]:
        odd = np.bitwise_count(np.arange(1, n + 1)[:, None] & np.array(vector)[None, :]) & 1
        return tuple(sum(1 << i for i in np.flatnonzero(row).tolist()) for row in odd)

    return max((masks(v) for v in tries), key=lambda m: min(x.bit_count() for x in m))


def spanning_links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of the least spanning forest of the graph that joins distinct prints at `radius` bits or fewer.

    Links are ordered by their bits, then by a hash of the pair, so all buckets order them alike and choose the same ones
    again and again: a link is left out only where lighter ones connect its ends. The forest grows by the lightest link
    that leaves it, so no pair list is made, whatever the size.
    """
    far, mix, mix2 = np.uint64((1 << 64) - 1), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
    out, rest, x = [], prints[1:].copy(), prints[:1]
    best, end = np.full(len(rest), far), np.zeros(len(rest), dtype=np.uint64)
    while len(rest):
        differ = rest ^ x
        bits = np.bitwise_count(differ)
        weight = (bits.astype(np.uint64) << np.uint64(57)) | ((differ * mix + (rest + x) * mix2) >> np.uint64(7))
        nearer = (bits <= radius) & (weight < best)
        best[nearer], end[nearer] = weight[nearer], x
        at = int(best.argmin())
        if best[at] < far:
            out.append((end[at], rest[at]))
        x = rest[at : at + 1].copy()
        for held in (rest, best, end):
            held[at] = held[-1]
        rest, best, end = rest[:-1], best[:-1], end[:-1]
    return out


def _runs_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal keys."""
    cut = np.flatnonzero(np.diff(key)) + 1
    start, end = np.r_[0, cut], np.r_[cut, len(key)]
    pair = start[end - start == 2]
    pair = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= radius]
    a, b = [fp[pair]], [fp[pair + 1]]
    for s, e in zip(start[end - start > 2].tolist(), end[end - start > 2].tolist(), strict=True):
        if links := spanning_links(np.unique(fp[s:e]), radius):
            x, y = zip(*links, strict=True)
            a.append(np.array(x, dtype=np.uint64))
            b.append(np.array(y, dtype=np.uint64))
    return np.concatenate(a), np.concatenate(b)


def _bucket_links(radius: int, hot: int | None, at_once: int = 1 << 17):
    """Streams rows (key, fp) in order of key. A run of more than `hot` rows is not kept: its key is passed on with `large`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _runs_links(key, fp, radius)
            keep = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64)), pa.array(np.zeros(int(keep.sum()), dtype=bool))], names=["a", "b", "large"])

        keys: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        skip, n = None, 0
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if skip is not None:
                key, fp = key[key != skip], fp[key != skip]
            keys.append(key)
            fps.append(fp)
            n += len(key)
            if n < at_once or not len(key):
                continue
            key, fp = np.concatenate(keys), np.concatenate(fps)
            last = int(np.searchsorted(key, key[-1]))
            whole, big, start = slice(0, last), [], 0
            if hot is not None and n - last > hot:
                skip = key[-1]
                big.append(int(skip))
                start = n
            yield from _whole(key[whole], fp[whole], hot, found, big)
            keys, fps = [key[max(last, start) :]], [fp[max(last, start) :]]
            n = len(keys[0])
        if n:
            yield from _whole(np.concatenate(keys), np.concatenate(fps), hot, found, [])

    return run


def _whole(key: np.ndarray, fp: np.ndarray, hot: int | None, found, big: list[int]) -> Iterator[pa.RecordBatch]:
    """Links of complete runs; runs of more than `hot` rows are named instead."""
    if hot is not None and len(key) > hot:
        value, size = np.unique(key, return_counts=True)
        big = big + value[size > hot].tolist()
        keep = ~np.isin(key, value[size > hot])
        key, fp = key[keep], fp[keep]
    if len(key):
        yield found(key, fp)
    if big:
        yield pa.RecordBatch.from_arrays([pa.array(big, pa.int64()), pa.array(big, pa.int64()), pa.array([True] * len(big))], names=["a", "b", "large"])


def _table_keys(prints: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """A bucket key for each print (rows) and mask (columns): the kept bits and the mask's number, mixed."""
    h = (prints[:, None] & masks[None, :]) + np.arange(1, len(masks) + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def in_tables(prints: DataFrame, radius: int, rows_at_once: int = 1000) -> DataFrame:
    """key for each covering mask beside all columns of prints(fp, ...): two prints within the radius share a key at least once."""
    masks = np.array(covering_masks(radius), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                keys = _table_keys(part.column("fp").to_numpy().view(np.uint64), masks)
                wide = part.take(pa.array(np.repeat(np.arange(part.num_rows), len(masks))))
                yield pa.RecordBatch.from_arrays([*wide.columns, pa.array(keys.ravel().view(np.int64))], names=[*part.schema.names, "key"])

    return prints.mapInArrow(run, StructType([*prints.schema.fields, StructField("key", LongType())]))


def split_keys(keys: DataFrame, radius: int, level: int) -> DataFrame:
    """Each row's key replaced by radius+1 finer ones: the word, turned by a few bits at each level, is cut into that many
    blocks, and a pair within the radius agrees on one block at least."""
    blocks, step, turn = radius + 1, 64 // (radius + 1), level * 64 // (radius + 1) // 3 + level
    fp = F.shiftrightunsigned("fp", turn).bitwiseOR(F.shiftleft("fp", 64 - turn)) if turn else F.col("fp")
    part = F.lit((1 << step) - 1).cast("long")
    parts = [F.xxhash64("key", F.lit(level), F.lit(i), (F.shiftrightunsigned(fp, i * step).bitwiseAND(part) if i < radius else F.shiftrightunsigned(fp, i * step))) for i in range(blocks)]
    return keys.withColumn("key", F.explode(F.array(*parts)))


def near_links(prints: DataFrame, radius: int = 3, hot: int = 4096, levels: int = 4, rows_per_task: int = 4_000_000) -> DataFrame:
    """Links a, b that connect exactly what pairs of distinct prints(fp) at `radius` bits or fewer connect.

    With a column `family`, prints link inside their family only.

    Every print goes into one bucket per covering mask; a pair within the radius meets in one at least. Tasks read their
    buckets in order, one in memory at a time; the number of tasks follows the number of prints. A bucket of more than
    `hot` prints is named instead and split by split_keys, `levels` times while there are such, so no link is lost and
    no task gets it whole; what is larger even then is cut into parts, and each pair of parts is a bucket. Each bucket
    gives a spanning forest, not pairs. A link that several buckets chose is there several times.
    """
    keys, tables = in_tables(prints, radius), (1 << (radius + 1)) - 1
    if "family" in keys.columns:
        keys = keys.withColumn("key", F.xxhash64("key", "family"))
    tasks = max(shuffle_parts(prints.sparkSession), -(-prints.count() * tables // rows_per_task))
    found = []
    for level in range(levels + 2):
        last = level > levels
        relieve(prints.sparkSession, 0.3)
        dealt = keys.repartition(tasks, "key").sortWithinPartitions("key")
        out, seen = materialize_seen(dealt.select("key", "fp").mapInArrow(_bucket_links(radius, None if last else hot), "a bigint, b bigint, large boolean"), large=F.count_if("large"))
        found.append(out.filter("NOT large").select("a", "b"))
        if last or not seen["large"]:
            break
        large = out.filter("large").select((F.col("a") + 1).alias("k1")).distinct()
        keys = keys.join(large, keys["key"] + 1 == large["k1"], "left_semi")
        keys = split_keys(keys, radius, level) if level < levels else pair_parts(materialize(keys), "fp", hot)
    return reduce(DataFrame.unionAll, found)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row per input row: __id, __hash (of the text), __fp, __root (a fingerprint that names the group) and __component, its smallest id.

    Fingerprints link at `radius` bits or fewer; a group is what links reach. Texts without words (null, empty, blank)
    have fingerprint 0 and link like any other. Null ids count for no minimum: a group of null ids has a null component.
    Repeated rows stay repeated. An empty table gives an empty result.
    """
    keyed = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("__hash"), F.col(text_col).alias("__body"))
    rows = materialize(with_fingerprint(keyed, ["__id", "__hash"], "__body"))
    prints = materialize(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min("__id").alias("low")))
    links = components(near_links(prints, radius))
    rooted = prints.join(links, prints["fp"] == links["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    # a component may hold a third of all fingerprints: its minimum is combined before the shuffle, and its rows may be split
    least = rooted.groupBy("root").agg(F.min("low").alias("__component")).select(F.concat(F.lit("r"), F.col("root").cast("string")).alias("k"), "__component")
    named = rooted.withColumn("k", F.concat(F.lit("r"), F.col("root").cast("string"))).join(least, "k").select((F.col("fp") + 1).alias("fp1"), F.col("root").alias("__root"), "__component")
    return rows.join(named, rows["__fp"] + 1 == named["fp1"]).select("__id", "__hash", "__fp", "__root", "__component")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", print_width: int = 2, radius: int = 5, seeds: tuple[int, ...] = (42, 43, 44, 45),
    width: int = 5, at_least: tuple[int, int] = (80, 100), block_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per input row: __id, __raw (a hash of the text) and __group: rows of one group are near copies.

    Every text has a family of SimHash fingerprints of its `print_width`-word shingles, one for each seed. Covering masks
    find all pairs of fingerprints of one family within `radius` bits; what those pairs connect is a candidate group, and
    its texts link where their sets of `width`-word shingles have Jaccard similarity at_least or more. All pairs of a
    candidate group are covered, in blocks of bounded size, so its size changes nothing (links_in_groups). A near-copy
    group is what links reach. Texts that are equal after lower-casing A-Z and joining words by one blank are one text
    with one set, so copies make no pairs.

    Null, empty and blank texts are one text. Null ids are kept. Repeated rows stay repeated. An empty table gives an
    empty result. Only id and text are read, so other columns' names do not matter.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    relieve(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    raw = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))

    def words_of(part: pa.RecordBatch) -> list[list[bytes]]:
        return [t.translate(LOWER).split() for t in raw_texts(part, "__text")]

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                lines = [b" ".join(w) for w in words_of(part)]
                prints = [np.array([fingerprint(t, print_width, s) for s in seeds], dtype=np.uint64).view(np.int64).tolist() for t in lines]
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__raw"), pa.array([xxhash.xxh3_128_hexdigest(t) for t in lines], pa.string()), pa.array(prints, pa.list_(pa.int64()))], names=["__id", "__raw", "key", "fps"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text"):
                sets = [shingle_set(w, width).tobytes() for w in words_of(part)]
                yield pa.RecordBatch.from_arrays([part.column("root"), part.column("key"), pa.array(sets, pa.binary()), pa.nulls(part.num_rows, pa.binary())], names=["root", "key", "shingles", "extra"])

    body = docs.select(F.col(id_col).alias("__id"), raw.alias("__raw"), F.col(text_col).alias("__text"))
    rows = materialize(body.mapInArrow(prints_of, f"__id {id_type}, __raw bigint, key string, fps array<bigint>"))
    each = rows.groupBy("key", "__id", "__raw").agg(F.first("fps").alias("fps"), F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("__id").isNull().alias("z"), "__id", "__raw", "times")).alias("m")
    texts = each.groupBy("key").agg(F.first("fps").alias("fps"), first)
    texts = texts.select("key", "fps", F.col("m.__id").alias("i"), F.col("m.__raw").alias("r"), F.col("m.times").alias("times"), F.xxhash64("key", F.lit(5)).alias("node"))
    texts, seen = materialize_seen(texts, repeated=F.count_if(F.col("times") > 1))
    relieve(spark, 0.3)
    prints = texts.select("node", F.posexplode("fps").alias("family", "fp"))
    held = materialize(prints.groupBy("fp", "family").agg(F.count(F.lit(1)).alias("texts"), F.min("node").alias("first")))
    links = materialize(near_links(held.select("fp", "family"), radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # a fingerprint stands for the first of its texts; its other texts hang on that one
    owners = held.groupBy("fp").agg(F.min("first").alias("first"))
    text_of = lambda c: owners.select((F.col("fp") + 1).alias(f"{c}1"), F.col("first").alias(f"{c}_text"))
    across = links.join(text_of("a"), F.col("a") + 1 == F.col("a1")).join(text_of("b"), F.col("b") + 1 == F.col("b1")).select(F.col("a_text").alias("a"), F.col("b_text").alias("b"))
    shared = held.filter("texts > 1").select((F.col("fp") + 1).alias("fp1"), "first").distinct()
    owned = prints.join(shared, prints["fp"] + 1 == shared["fp1"]).select(F.col("node").alias("a"), F.col("first").alias("b"))
    roots = components(materialize(across).unionAll(owned))
    rooted = materialize(texts.join(roots, "node").select("root", "key", "i", "r", "times"))
    relieve(spark, 0.3)
    several = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select((F.col("root") + 1).alias("r1"))
    maybe = rooted.join(several, rooted["root"] + 1 == several["r1"], "left_semi")
    bodies = body.join(maybe, F.col("i").eqNullSafe(F.col("__id")) & (F.col("r") == F.col("__raw")))
    sets = bodies.select("root", "key", "__text").mapInArrow(sets_of, "root bigint, key string, shingles binary, extra binary")
    if seen["repeated"]:  # rows that agree in id and text gave one set each
        sets = sets.groupBy("root", "key").agg(F.first("shingles").alias("shingles"), F.first("extra").alias("extra"))
    sets = materialize(sets)
    groups = materialize(components(links_in_groups(sets, at_least, block_bytes)).select(F.col("node").alias("k2"), "root"))
    discard(sets, texts, held, links, rooted)
    relieve(spark, 0.3)
    return rows.join(groups, rows["key"] == groups["k2"], "left").select("__id", "__raw", F.coalesce("root", "key").alias("__group"))


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
