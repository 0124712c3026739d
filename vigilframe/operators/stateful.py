"""Ordered state per key: folds that no window frame expresses, streamed through sorted partitions."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType, StructField, StructType


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], object], out: str, out_type: str) -> DataFrame:
    """Adds `out`, what step(state, row) returns for each row of a key in order.

    Rows are hashed by key and sorted, and the state is carried from batch to batch: memory holds one key's state, not
    its rows, so a key of any size streams through. Values stay what Arrow holds: null keys are one key, and whole
    numbers beside nulls stay whole.
    """
    names = df.columns
    at_key = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for batch in batches:
            got, columns = [], [c.to_pylist() for c in batch.columns]
            for values in zip(*columns, strict=True):
                key = tuple(values[i] for i in at_key)
                if key != at:
                    at, state = key, start()
                got.append(step(state, dict(zip(names, values, strict=True))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, type=arrow_type)], names=[*names, out])

    schema = StructType([*df.schema.fields, StructField(out, DataType.fromDDL(out_type))])
    arrow_type = to_arrow_type(schema[-1].dataType)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema).select(*names, out)


class FindTime:
    """max_failures inside find_time: old entries fall out; on reaching the limit it fires and forgets all."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window, self.seen = limit, window_us, deque()

    def __call__(self, row: dict) -> bool:
        now = row["us"]
        while self.seen and self.seen[0] <= now - self.window:
            self.seen.popleft()
        self.seen.append(now)
        if len(self.seen) >= self.limit:
            self.seen.clear()
            return True
        return False


class FixedWindow:
    """A window from its first event; an event after its end opens the next and does not fire. Fires while the count is at least the limit."""

    closed = True  # an event at the very end is inside

    def of(self, window: Column, place: Column, opened: Column) -> Column:
        return (place > 0) & (place + 1 >= self.limit)

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window, self.first, self.n = limit, window_us, None, 0

    def __call__(self, row: dict) -> bool:
        now = row["us"]
        if self.first is None or now - self.first > self.window:
            again = self.first is not None
            self.first, self.n = now, 1
            return not again and self.n >= self.limit and self.limit > 1
        self.n += 1
        return self.n >= self.limit


class RuleThreshold:
    """limit: the first n of a window; threshold: every n-th; both: once per window after n. A window restarts at the first event after its end."""

    closed = True

    def of(self, window: Column, place: Column, opened: Column) -> Column:
        n = place + 1
        return {"limit": n <= self.limit, "threshold": n % self.limit == 0}.get(self.kind, n == self.limit)

    def __init__(self, kind: str, n: int, window_us: int):
        self.kind, self.limit, self.window, self.first, self.n = kind, n, window_us, None, 0

    def __call__(self, row: dict) -> bool:
        if self.first is None or row["us"] - self.first > self.window:
            self.first, self.n = row["us"], 0
        self.n += 1
        if self.kind == "limit":
            return self.n <= self.limit
        if self.kind == "threshold":
            return self.n % self.limit == 0
        return self.n == self.limit


class FirstSeen:
    """True for the first of a run of events inside window_us of it; the window is not refreshed."""

    closed = False  # an event at the very end opens the next window

    def of(self, window: Column, place: Column, opened: Column) -> Column:
        return place == 0

    def __init__(self, window_us: int):
        self.window, self.first = window_us, None

    def __call__(self, row: dict) -> bool:
        if self.first is None or row["us"] - self.first >= self.window:
            self.first = row["us"]
            return True
        return False


class DistinctPorts:
    """Distinct ports by first sight inside a window; fires at the limit and forgets the address."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window, self.seen = limit, window_us, {}

    def __call__(self, row: dict) -> bool:
        now = row["us"]
        self.seen = {p: t for p, t in self.seen.items() if t > now - self.window}
        self.seen.setdefault(row["port"], now)
        if len(self.seen) >= self.limit:
            self.seen = {}
            return True
        return False


class AnchoredWindow:
    """Number of the window that an event is in: a window opens at its first event and ends window_us after it."""

    closed = True

    def of(self, window: Column, place: Column, opened: Column) -> Column:
        return window

    def __init__(self, window_us: int):
        self.window, self.first, self.n = window_us, None, -1

    def __call__(self, row: dict) -> int:
        if self.first is None or row["us"] > self.first + self.window:
            self.first, self.n = row["us"], self.n + 1
        return self.n


class SlidingLimit:
    """Allows an action while fewer than `limit` allowed ones lie in the last window_us; denied ones are not recorded."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window, self.seen = limit, window_us, deque()

    def __call__(self, row: dict) -> bool:
        while self.seen and self.seen[0] <= row["us"] - self.window:
            self.seen.popleft()
        if len(self.seen) < self.limit:
            self.seen.append(row["us"])
            return True
        return False


class Ema:
    """Exponential mean and variance; the first sample seeds the mean and a variance of 1, which never falls below 1e-6."""

    def __init__(self, alpha: float):
        self.alpha, self.mean, self.var = alpha, None, 1.0

    def __call__(self, row: dict) -> dict:
        x = row["value"]
        if self.mean is None:
            self.mean = x
        else:
            d = x - self.mean
            self.mean += self.alpha * d
            self.var = max(1e-6, (1 - self.alpha) * self.var + self.alpha * d * (x - self.mean))
        return {"mean": self.mean, "var": self.var}


class Flowbits:
    """Named bits of a connection: set, unset and toggle change them; isset asks."""

    def __init__(self):
        self.bits: set[str] = set()

    def __call__(self, row: dict) -> bool:
        op, bit = row["op"], row["bit"]
        if op == "set":
            self.bits.add(bit)
        elif op == "unset":
            self.bits.discard(bit)
        elif op == "toggle":
            self.bits ^= {bit}
        return bit in self.bits


def anchored_windows(df: DataFrame, keys: list[str], order: list[str], window_us: int, closed: bool = True) -> DataFrame:
    """df with __window, the number of the window of its key that a row is in, __place, its place there, and __opened, when it opened.

    A window opens at the first row of a key that no window before it holds, and lasts window_us from its time, order[0];
    closed: its end included. Sorted partitions stream through; a key's times are searched for each window's end, so Python
    takes one step a window, not a row, and one key's window is the state from batch to batch. Null times are not expected.
    """
    names, at_us = df.columns, df.columns.index(order[0])
    at_key, side = [df.columns.index(k) for k in keys], "right" if closed else "left"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window, place, opened = object(), -1, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            us = batch.column(at_us).to_numpy(zero_copy_only=False)
            change = np.zeros(n - 1, dtype=bool)
            for c in (batch.column(i) for i in at_key):
                was, now = c.slice(0, n - 1), c.slice(1)
                change |= pc.or_(pc.fill_null(pc.not_equal(was, now), False), pc.xor(was.is_null(), now.is_null())).to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.flatnonzero(change) + 1, n]
            out = np.empty((3, n), dtype=np.int64)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                mine = tuple(batch.column(i)[s].as_py() for i in at_key)
                if mine != key:
                    key, window, place, opened = mine, -1, 0, None
                while s < e:
                    end = s if opened is None else s + int(np.searchsorted(us[s:e], opened + window_us, side))
                    if end == s:
                        window, place, opened = window + 1, 0, int(us[s])
                        end = max(s + 1, s + int(np.searchsorted(us[s:e], opened + window_us, side)))
                    out[0, s:end], out[1, s:end], out[2, s:end] = window, np.arange(place, place + end - s), opened
                    place, s = place + end - s, end
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in out)], names=[*names, "__window", "__place", "__opened"])

    schema = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in ("__window", "__place", "__opened"))])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fold(df: DataFrame, keys: list[str], make: Callable[[], Callable], out: str = "fired", out_type: str = "boolean", order: tuple[str, ...] = ("us", "event_id")) -> DataFrame:
    """ordered_fold with one of the states above; those of anchored windows become an expression over anchored_windows."""
    state = make()
    if hasattr(state, "of"):
        rows = anchored_windows(df, keys, list(order), state.window, state.closed)
        return rows.withColumn(out, state.of(F.col("__window"), F.col("__place"), F.col("__opened")).cast(out_type)).select(*df.columns, out)
    return ordered_fold(df, keys, list(order), make, lambda state, row: state(row), out, out_type)


def range_window(keys: list[str], window_us: int, current: bool = True):
    return Window.partitionBy(*keys).orderBy("us").rangeBetween(-window_us, 0 if current else -1)


def distinct_in_window(df: DataFrame, keys: list[str], value: str, window_us: int, name: str) -> DataFrame:
    """df with the number of distinct non-null values of its key in the window_us up to each row, its own time included.

    A value counts from its row until the window has passed it or the same value comes again. Those starts and ends are
    summed in order of time, so no frame gathers a set and the work is linear.
    """
    again = F.lead("us").over(Window.partitionBy(*keys, value).orderBy("us"))
    end = F.least(F.col("us") + window_us + 1, F.coalesce(again, F.col("us") + window_us + 1))
    counted = F.col(value).isNotNull().cast("long")
    steps = F.array(F.struct(F.col("us").alias("__at"), counted.alias("__d"), F.lit(True).alias("__row")), F.struct(F.col("__end").alias("__at"), (-counted).alias("__d"), F.lit(False).alias("__row")))
    both = df.withColumn("__end", end).select(*df.columns, F.inline(steps))
    total = F.sum("__d").over(Window.partitionBy(*keys).orderBy("__at").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, total).filter("__row").select(*df.columns, name)


def gap_buckets(df: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """bucket and place of each row among its key's runs of events no more than gap_us apart."""
    w = Window.partitionBy(*keys).orderBy("us", "event_id")
    new = F.coalesce((F.col("us") - F.lag("us").over(w) > gap_us).cast("int"), F.lit(0))
    df = df.withColumn("bucket", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("us", "event_id")))


def next_after(keys: list[str], matches: Column, value: Column) -> Column:
    """Value of the first later row of the key that matches: a backward running minimum."""
    w = Window.partitionBy(*keys).orderBy("us").rangeBetween(1, Window.unboundedFollowing)
    return F.min(F.when(matches, value)).over(w)
