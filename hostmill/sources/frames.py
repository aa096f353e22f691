"""Captured Ethernet frames to packet rows.

The header fields sit at fixed or self-told places, read for a whole Arrow batch at once by
offsets into its bytes. VLAN tags and IPv6 extension headers are followed as far as a frame
goes: each round reads the next one of the frames that still have any. Frames that are short,
later fragments, or neither TCP nor UDP over IP are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..shipping import ship

_VLAN = (0x8100, 0x88A8, 0x9100)
_V4, _V6 = 0x0800, 0x86DD
_TCP, _UDP = 6, 17
_SIZED, _FRAGMENT, _AUTH = (0, 43, 60), 44, 51
_PACKET = "proto int, src_addr binary, dst_addr binary, src_v4 boolean, dst_v4 boolean, src_port int, dst_port int, bytes bigint, tcp_start boolean"


class Bytes:
    """The frames of a batch: big-endian numbers at places from 0 in each, -1 beyond the end."""

    def __init__(self, frames: pa.Array):
        frames = frames.cast(pa.large_binary())
        offsets = np.frombuffer(frames.buffers()[1], np.int64)[frames.offset : frames.offset + len(frames) + 1]
        self.start, self.length = offsets[:-1], np.diff(offsets)
        data = frames.buffers()[2]
        self.data = np.append(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.uint8(0))

    def number(self, at: np.ndarray | int, size: int) -> np.ndarray:
        at = np.broadcast_to(np.asarray(at, np.int64), self.length.shape)
        there = (at >= 0) & (at + size <= self.length)
        first = np.where(there, self.start + at, 0)
        n = np.zeros(len(first), np.int64)
        for k in range(size):
            n = n * 256 + self.data[np.minimum(first + k, len(self.data) - 1)]
        return np.where(there, n, -1)

    def texts(self, at: np.ndarray, size: int) -> np.ndarray:
        """size bytes of every frame as rows of a matrix."""
        first = self.start + at
        return self.data[np.minimum(first[:, None] + np.arange(size), len(self.data) - 1)]


def decoded(f: Bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which frames are packets, and the packets' fields for every frame."""
    kind, at = f.number(12, 2), np.full(len(f.length), 14, np.int64)
    while (tagged := np.isin(kind, _VLAN)).any():
        kind = np.where(tagged, f.number(at + 2, 2), kind)
        at = np.where(tagged, at + 4, at)
    size = f.length - at
    first = f.number(at, 1)
    v4, v6 = kind == _V4, kind == _V6
    header, told = first % 16 * 4, f.number(at + 2, 2)
    v4_good = v4 & (size >= 20) & (first // 16 == 4) & (header >= 20) & (size >= header) & (told >= header) & (f.number(at + 6, 2) % 8192 == 0)
    v6_good = v6 & (size >= 40) & (first // 16 == 6)
    proto, tp = np.where(v4, f.number(at + 9, 1), f.number(at + 6, 1)), np.where(v4, at + header, at + 40)
    while True:
        sized, fragment, auth = np.isin(proto, _SIZED), proto == _FRAGMENT, proto == _AUTH
        more = v6_good & (sized | fragment | auth)
        if not more.any():
            break
        count = f.number(tp + 1, 1)
        step = np.where(fragment, 8, np.where(auth, (count + 2) * 4, (count + 1) * 8))
        whole = np.where(fragment, (f.number(tp + 7, 1) >= 0) & (f.number(tp + 2, 2) // 8 == 0), count >= 0)
        v6_good &= ~more | whole
        proto, tp = np.where(more, f.number(tp, 1), proto), np.where(more, tp + step, tp)
    tcp = proto == _TCP
    good = (v4_good | v6_good) & (tcp | (proto == _UDP)) & (f.length >= tp + np.where(tcp, 20, 4))
    flags = f.number(tp + 13, 1)
    at = np.where(good, at, 0)
    mapped = np.zeros((len(at), 2, 16), np.uint8)
    mapped[:, 0, 12:], mapped[:, 1, 12:] = f.texts(at + 12, 4), f.texts(at + 16, 4)
    addresses = np.where(v4[:, None, None], mapped, np.stack([f.texts(at + 8, 16), f.texts(at + 24, 16)], axis=1))
    length = np.where(v4, told, f.number(at + 4, 2) + 40)
    fields = {
        "proto": proto, "src_addr": addresses[:, 0], "dst_addr": addresses[:, 1], "src_v4": v4, "dst_v4": v4, "src_port": f.number(tp, 2),
        "dst_port": f.number(tp + 2, 2), "bytes": np.minimum(length, size), "tcp_start": tcp & (flags & 2 != 0) & (flags & 16 == 0),
    }
    return good, fields


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def packets_from_frames(df: DataFrame, frame: str = "frame") -> DataFrame:
    """The other columns with proto, addresses (16 bytes), ports, bytes and tcp_start."""
    ship(df.sparkSession)
    rest = [c for c in df.columns if c != frame]
    own = StructType.fromDDL(_PACKET)
    schema = StructType([df.schema[c] for c in rest] + own.fields)
    types = {"proto": pa.int32(), "src_port": pa.int32(), "dst_port": pa.int32(), "bytes": pa.int64(), "src_v4": pa.bool_(), "dst_v4": pa.bool_(), "tcp_start": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, fields = decoded(Bytes(batch.column(batch.schema.get_field_index(frame))))
            kept = batch.select(rest).filter(pa.array(good))
            cols = [_binary(v[good]) if v.ndim == 2 else pa.array(v[good]).cast(types[k]) for k, v in fields.items()]
            yield pa.RecordBatch.from_arrays([*kept.columns, *cols], names=[*rest, *fields])

    return df.select(*rest, frame).mapInArrow(run, schema)
