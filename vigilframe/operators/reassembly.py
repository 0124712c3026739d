"""Reassembly: TCP segments in sequence order and IP fragments of a datagram, as ordered folds with bounded state."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stateful import ordered_fold

#: Bytes that a segment may lie ahead, bytes held back, the smallest fragment, the largest datagram, seconds.
MAX_GAP, MAX_HELD, MIN_FRAGMENT, MAX_DATAGRAM, FRAGMENT_TIMEOUT = 65_535, 1 << 20, 28, 65_535, 30


def _before(a: int, b: int) -> bool:
    """Sequence numbers a, b of 32 bits: a lies less than half of the circle behind b."""
    return 0 < (b - a) % (1 << 32) < 1 << 31


class SegmentBuffer:
    """One direction of a connection. Takes rows (syn, seq, data), gives the segment's kind and the text that it releases.

    syn: sets the first number. in_order: what was expected; it releases itself and all held segments that follow on.
    held: ahead by at most MAX_GAP while less than MAX_HELD bytes are held; else refused. old: begins before what is
    expected. Without a SYN the first segment is what is expected. Held segments are looked at from the smallest number,
    so a held one beyond the wrap-around waits for none.
    """

    def __init__(self):
        self.next: int | None = None
        self.held: dict[int, str] = {}
        self.order: list[int] = []
        self.bytes = 0

    def _forget(self) -> str:
        data = self.held.pop(self.order.pop(0))
        self.bytes -= len(data.encode())
        return data

    def __call__(self, row: dict) -> dict:
        seq, data = row["seq"], row["data"] or ""
        if row["syn"]:
            self.next = (seq + 1) % (1 << 32)
            return {"kind": "syn", "released": ""}
        if not data:
            return {"kind": "empty", "released": ""}
        size = len(data.encode())
        if self.next is None:
            self.next = seq
        if seq == self.next:
            self.next, out = (seq + size) % (1 << 32), [data]
            while self.order:
                first = self.order[0]
                if first == self.next:
                    self.next = (first + len(self.held[first].encode())) % (1 << 32)
                    out.append(self._forget())
                elif _before(first, self.next):
                    self._forget()
                else:
                    break
            return {"kind": "in_order", "released": "".join(out)}
        if not _before(self.next, seq):
            return {"kind": "old", "released": ""}
        if (seq - self.next) % (1 << 32) > MAX_GAP or self.bytes >= MAX_HELD:
            return {"kind": "refused", "released": ""}
        if seq in self.held:
            self.bytes -= len(self.held[seq].encode())
        else:
            insort(self.order, seq)
        self.held[seq] = data
        self.bytes += size
        return {"kind": "held", "released": ""}


def reassemble(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """segments(keys, order, syn, seq, data) with kind and released, what each segment lets through to the application."""
    out = ordered_fold(segments, keys, order, SegmentBuffer, lambda state, row: state(row), "__got", "struct<kind: string, released: string>")
    return out.select(*segments.columns, "__got.kind", "__got.released")


class FragmentGroup:
    """Fragments of one (source, destination, id). Takes rows (at, offset, size, more): seconds, units of 8 bytes, bytes, flag.

    Stored fragments never overlap, because one that does is reported and not stored; so an overlap is with a neighbour,
    and the datagram is whole when the stored bytes reach as far as the end and leave no gap. A whole datagram begins anew,
    as does one whose first fragment is older than FRAGMENT_TIMEOUT, which counts as incomplete.
    """

    def __init__(self):
        self.first: float | None = None
        self.stored: list[tuple[int, int]] = []
        self.total = self.covered = self.reach = 0
        self.end: int | None = None

    def __call__(self, row: dict) -> dict:
        expired = self.first is not None and row["at"] - self.first > FRAGMENT_TIMEOUT
        if expired:
            self.__init__()
        if self.first is None:
            self.first = row["at"]
        size, start = row["size"], row["offset"] * 8
        end, self.total = start + size, self.total + size
        if not row["more"]:
            self.end = end
        place = bisect_left(self.stored, (start, end))
        near = self.stored[max(0, place - 2) : place + 1]
        overlap = any(start < b and end > a for a, b in near)
        if not overlap:
            self.stored.insert(place, (start, end))
            self.covered, self.reach = self.covered + size, max(self.reach, end)
        oversized = self.end if (self.end or 0) > MAX_DATAGRAM else self.total if self.total > MAX_DATAGRAM else None
        whole = self.end is not None and self.covered == self.reach >= self.end
        opened = self.first
        if whole:
            self.__init__()
        return {"tiny": size < MIN_FRAGMENT and row["more"], "overlap": overlap, "oversized": oversized, "completed": whole, "expired": expired, "opened": opened}


FRAGMENT_OUT = "struct<tiny: boolean, overlap: boolean, oversized: bigint, completed: boolean, expired: boolean, opened: double>"


def track_fragments(fragments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """fragments(keys, order, at, offset, size, more) with what each one shows: tiny, overlap, oversized, completed, expired."""
    out = ordered_fold(fragments, keys, order, FragmentGroup, lambda state, row: state(row), "__got", FRAGMENT_OUT)
    return out.select(*fragments.columns, "__got.*")


def fragment_ratios(tracked: DataFrame, by: list[str], last: DataFrame, packets: Column) -> DataFrame:
    """The four fragment features for each value of `by`: fragments per packet, and overlapping, incomplete and tiny ones per fragment.

    last(at) is one row: groups still open more than FRAGMENT_TIMEOUT before it are incomplete too. packets: all packets of a row's source.
    """
    share = lambda c: F.sum(c.cast("long")) / F.count(F.lit(1))
    stale = F.col("latest") & ~F.col("completed") & (F.col("end") - F.col("opened") > FRAGMENT_TIMEOUT)
    rows = tracked.join(F.broadcast(last.select(F.col("at").alias("end"))))
    lost = F.sum(F.col("expired").cast("long")) + F.sum(F.coalesce(stale, F.lit(False)).cast("long"))
    return rows.groupBy(*by).agg(
        (F.count(F.lit(1)) / F.greatest(F.max(packets), F.lit(1))).alias("rate"), share(F.col("overlap")).alias("overlap"), (lost / F.count(F.lit(1))).alias("incomplete"), share(F.col("tiny")).alias("tiny"),
    )
