"""Capture files: one row per packet, decoded up to the transport layer."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "file string, packet_id long, us long, src_ip string, dst_ip string, proto int, ttl int, src_port int, dst_port int, flags int, vlan int, payload binary, raw_len long"
#: Byte order and ticks per microsecond by the file's magic number.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}


def decode(frame: bytes) -> dict | None:
    """Ethernet, one VLAN tag, IPv4 and TCP, UDP or ICMP; None for anything else or a frame cut short."""
    if len(frame) < 34:
        return None
    kind, at, vlan = int.from_bytes(frame[12:14], "big"), 14, None
    if kind == 0x8100 and len(frame) >= 38:
        vlan, kind, at = int.from_bytes(frame[14:16], "big") & 0xFFF, int.from_bytes(frame[16:18], "big"), 18
    if kind != 0x0800 or frame[at] >> 4 != 4:
        return None
    head, total, proto = (frame[at] & 15) * 4, int.from_bytes(frame[at + 2 : at + 4], "big"), frame[at + 9]
    out = {"src_ip": ".".join(map(str, frame[at + 12 : at + 16])), "dst_ip": ".".join(map(str, frame[at + 16 : at + 20])), "proto": proto, "ttl": frame[at + 8], "src_port": 0, "dst_port": 0, "flags": 0, "vlan": vlan}
    body = frame[at + head : at + total]
    if proto == 6 and len(body) >= 20:
        out |= {"src_port": int.from_bytes(body[:2], "big"), "dst_port": int.from_bytes(body[2:4], "big"), "flags": body[13]}
        body = body[(body[12] >> 4) * 4 :]
    elif proto == 17 and len(body) >= 8:
        out |= {"src_port": int.from_bytes(body[:2], "big"), "dst_port": int.from_bytes(body[2:4], "big")}
        body = body[8:]
    return out | {"payload": bytes(body)}


def packets_of(data: bytes) -> Iterator[dict]:
    if data[:4] not in MAGIC:
        return
    order, ticks = MAGIC[data[:4]]
    at, n = 24, 0
    while at + 16 <= len(data):
        sec, frac, have, wire = struct.unpack(f"{order}IIII", data[at : at + 16])
        row = decode(data[at + 16 : at + 16 + have])
        at += 16 + have
        if row:
            yield row | {"packet_id": n, "us": sec * 1_000_000 + frac // ticks, "raw_len": wire}
        n += 1


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all capture files under a path, one task per group of files; large captures are best split by the recorder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows: list[dict] = []
                for row in packets_of(bytes(data)):
                    rows.append(row | {"file": name})
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows)[names].astype({"vlan": "Int32"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)[names].astype({"vlan": "Int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
