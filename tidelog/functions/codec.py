"""Checksums and binary entries, in numpy and Arrow."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEY_LIMIT, CorruptFile

_ENTRY = struct.Struct("<HIQB")


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0x82F63B78), out >> 1)
    return out.astype(np.uint32)


_CASTAGNOLI = _table()


def crc32c_many(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of every part. Parts advance together, byte by byte, the longest last."""
    out = np.full(len(parts), 0xFFFFFFFF, dtype=np.uint32)
    if not parts:
        return out
    sizes = np.array([len(x) for x in parts])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    order = np.argsort(-sizes, kind="stable")
    at, alive = starts[order], len(parts)
    state, lengths = out[order], sizes[order]
    for k in range(int(sizes.max()) if len(sizes) else 0):
        while alive and lengths[alive - 1] <= k:
            alive -= 1
        if alive == 1:  # one long part is left
            value = int(state[0])
            for byte in data[at[0] + k : at[0] + lengths[0]].tolist():
                value = int(_CASTAGNOLI[(value ^ byte) & 0xFF]) ^ (value >> 8)
            state[0] = value
            break
        now = state[:alive]
        state[:alive] = _CASTAGNOLI[(now ^ data[at[:alive] + k]) & 0xFF] ^ (now >> np.uint32(8))
    out[order] = state
    return out ^ np.uint32(0xFFFFFFFF)


def crc32c(data: bytes) -> int:
    return int(crc32c_many([data])[0])


def pack_entry(key: bytes | None, value: bytes | None, ts: int, tombstone: bool) -> bytes:
    key, value = key or b"", (b"" if tombstone else value or b"")
    if len(key) > KEY_LIMIT:
        raise ValueError(f"a key has {len(key)} bytes, {KEY_LIMIT} at most are allowed")
    return _ENTRY.pack(len(key), len(value), ts & 0xFFFFFFFFFFFFFFFF, 2 if tombstone else 1) + key + value


def unpack_entries(data: bytes) -> Iterator[tuple[bytes, bytes | None, int, bool]]:
    """Entries to the end of the data. CorruptFile if it ends within one or has an unknown operation."""
    at = 0
    while at < len(data):
        if at + _ENTRY.size > len(data):
            raise CorruptFile(f"an entry's header is cut short at byte {at}")
        keys, values, ts, op = _ENTRY.unpack_from(data, at)
        at += _ENTRY.size
        if at + keys + values > len(data):
            raise CorruptFile(f"an entry is cut short at byte {at}")
        if op not in (1, 2):
            raise CorruptFile(f"unknown operation {op} at byte {at}")
        yield data[at : at + keys], None if op == 2 else data[at + keys : at + keys + values], ts - (ts >> 63 << 64), op == 2
        at += keys + values


def encode_entries(df: DataFrame) -> DataFrame:
    """key, value, ts_nanos, tombstone, and anything else -> the same with `entry`."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("key", "value", "ts_nanos", "tombstone")), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pack_entry(*r) for r in rows], pa.binary())], names=[*b.schema.names, "entry"])

    schema = df.withColumn("entry", F.lit(b"")).schema
    return df.mapInArrow(run, schema)


def decode_entries(df: DataFrame, column: str = "entry") -> DataFrame:
    """The rows (key, value, ts_nanos, tombstone) of entries, any number in each binary value."""

    def run(batches):
        for b in batches:
            rows = [r for x in b.column(0) if x.is_valid for r in unpack_entries(x.as_py())]
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "value", "ts_nanos", "tombstone"])

    return df.select(column).mapInArrow(run, "key binary, value binary, ts_nanos bigint, tombstone boolean")
