"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, text_or_empty


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser as round function."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _keys(seed: int, rounds: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(1, 1 << 62, rounds)]


def permute(rows: np.ndarray, n: int, seed: int = 0, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """The place of each row number in a permutation of range(n), or with inverse the row number at each place.

    The network works on the smallest even number of bits that holds n; places at or beyond n walk on along their cycle
    until they fall below n, which keeps the map a permutation of range(n). 4 steps at most are expected.
    """
    bits = max(2, (max(n - 1, 1)).bit_length())
    half = (bits + 1) // 2
    low, keys = np.uint64((1 << half) - 1), _keys(seed, rounds)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & low), left
            else:
                left, right = right, left ^ (_mix(right, k) & low)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(rows, dtype=np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def locate(rows: np.ndarray, n: int, shards: int = 8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers, without looking at any data."""
    place = permute(rows, n, seed)
    return place % shards, place // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = 8, seed: int = 0) -> np.ndarray:
    """The global row number that locate() puts there."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, seed, inverse=True)


def number_rows(df: DataFrame, order: list, rows_per_bucket: int = 50_000, least_buckets: int = 256) -> tuple[DataFrame, int]:
    """Adds __number, gapless from 0, and gives the number of rows.

    Rows are dealt to hash buckets of `order`, counted by bucket (one row per bucket reaches the driver) and numbered
    inside each bucket, so a task sorts about rows_per_bucket rows whatever the size. Equal tuples of `order` are
    interchangeable.
    """
    buckets = max(least_buckets, -(-df.count() // rows_per_bucket))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = {r[0]: r[1] for r in df.groupBy("__bucket").count().collect()}
    starts, total = {}, 0
    for b in sorted(counts):
        starts[b], total = total, total + counts[b]
    spark = df.sparkSession
    table = spark.createDataFrame([(b, s) for b, s in starts.items()], "__bucket int, __start long")
    within = Window.partitionBy("__bucket").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    out = df.withColumn("__in", F.row_number().over(within)).join(F.broadcast(table), "__bucket")
    return out.withColumn("__number", F.col("__start") + F.col("__in") - 1).drop("__bucket", "__in", "__start"), total


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] | None = None, rows_per_bucket: int = 50_000) -> DataFrame:
    """Every input row as __row, a struct of the columns `carry` (None: all), with __id, __size, __crc, __shard and __slot.

    The law is `rows`: shard counts differ by one at most and slots are gapless from 0. Row numbers follow a hash of id,
    CRC-32 of the text and size, so they do not depend on files or partitions; rows that agree in all three are
    interchangeable. Null text has size 1 and CRC 0; null ids are numbered like others. Very long texts count as any row.
    The caller's columns are in a struct, so their names cannot clash. An empty table gives an empty result. Only the
    columns to carry are shuffled, once.
    """
    text = text_or_empty(text_col)
    own = {"__id": F.col(id_col), "__size": (F.octet_length(text) + 1).cast("long"), "__crc": F.crc32(text.cast("binary"))}
    rows = [packed(docs, carry)] if carry is None or carry else []
    numbered, n = number_rows(docs.select(*rows, *[v.alias(k) for k, v in own.items()]), ["__id", "__crc", "__size"], rows_per_bucket)

    @F.pandas_udf("shard int, slot long")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            shard, slot = locate(rows.to_numpy(), n, shards, seed)
            yield pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    out = numbered.withColumn("__at", place("__number"))
    return out.withColumns({"__shard": F.col("__at.shard"), "__slot": F.col("__at.slot")}).drop("__at", "__number")
