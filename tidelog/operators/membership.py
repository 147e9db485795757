"""Bloom filters over keys: FNV-1a with double hashing, built by partition and merged by or."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import bloom_bits
from ..model import CorruptFile

_PRIME, _OFFSET = np.uint64(0x100000001B3), np.uint64(0xCBF29CE484222325)


def fnv1a(keys: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of every key; the keys advance together."""
    sizes = np.array([len(x) for x in keys], dtype=np.int64)
    out = np.full(len(keys), _OFFSET, dtype=np.uint64)
    data = np.frombuffer(b"".join(keys), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    for k in range(int(sizes.max()) if len(sizes) else 0):
        open_ = np.flatnonzero(sizes > k)
        out[open_] = (out[open_] ^ data[starts[open_] + k]) * _PRIME
    return out


def _places(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    both = fnv1a(keys)
    low, high = both.astype(np.uint32), (both >> np.uint64(32)).astype(np.uint32)
    return (low[:, None] + np.arange(hashes, dtype=np.uint32)[None, :] * high[:, None]) % np.uint32(bits)


@dataclass(frozen=True)
class Bloom:
    bits: int
    hashes: int
    data: bytes

    def may_contain(self, keys: list[bytes]) -> np.ndarray:
        at = _places(keys, self.bits, self.hashes)
        held = np.frombuffer(self.data, dtype=np.uint8)
        return ((held[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & 1).all(axis=1)

    def dump(self) -> bytes:
        return struct.pack("<IB", self.bits, self.hashes) + self.data

    @staticmethod
    def load(data: bytes) -> Bloom:
        if len(data) < 5:
            raise CorruptFile("a bloom filter has five bytes at least")
        bits, hashes = struct.unpack_from("<IB", data)
        if not bits or not hashes or len(data) - 5 != -(-bits // 8):
            raise CorruptFile("a bloom filter's size is not that of its bits")
        return Bloom(bits, hashes, data[5:])

    @staticmethod
    def of(keys: list[bytes], items: int | None = None, rate: float = 0.01) -> Bloom:
        bits, hashes = bloom_bits(len(keys) if items is None else items, rate)
        return Bloom(bits, hashes, _set(keys, bits, hashes).tobytes())


def _set(keys: list[bytes], bits: int, hashes: int) -> np.ndarray:
    out = np.zeros(-(-bits // 8), dtype=np.uint8)
    if keys:
        at = _places(keys, bits, hashes).ravel()
        np.bitwise_or.at(out, at >> np.uint32(3), np.uint8(1) << (at & np.uint32(7)).astype(np.uint8))
    return out


#: A filter is one value on the driver and in every executor; beyond so many bytes, partition the keys and build one each.
MOST_BYTES = 256 << 20
_PIECE, _FAN = 1 << 16, 64


def build(df: DataFrame, key: str, rate: float = 0.01, items: int | None = None) -> Bloom:
    """The filter over a binary or text column. Null keys count as empty. Partial filters are merged in pieces of 64 KiB, first in _FAN parts."""
    keys = df.select(F.coalesce(F.col(key).cast("binary"), F.lit(b"")).alias("key"))
    bits, hashes = bloom_bits(keys.count() if items is None else items, rate)
    if bits // 8 > MOST_BYTES or bits >= 1 << 32:
        raise ValueError(f"the filter would have {bits // 8} bytes; build one for each part of the keys")

    def partial(batches):
        held, task = None, TaskContext.get().partitionId() % _FAN
        for b in batches:
            own = _set(b.column(0).to_pylist(), bits, hashes)
            held = own if held is None else held | own
        if held is not None:
            pieces = [(at, held[at : at + _PIECE].tobytes()) for at in range(0, len(held), _PIECE) if held[at : at + _PIECE].any()]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int64()), pa.array([task] * len(pieces), pa.int64()), pa.array([p[1] for p in pieces], pa.binary())], names=["at", "part", "bits"])

    def either(group: pa.Table) -> pa.Table:
        merged = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in group.column("bits").to_pylist()])
        return pa.table({"at": group.column("at")[:1], "part": group.column("part")[:1], "bits": pa.array([merged.tobytes()], pa.binary())})

    schema = "at bigint, part bigint, bits binary"
    whole = np.zeros(-(-bits // 8), dtype=np.uint8)
    merged = keys.mapInArrow(partial, schema).groupBy("at", "part").applyInArrow(either, schema).groupBy("at").applyInArrow(either, schema)
    for r in merged.collect():  # MOST_BYTES at most
        whole[r["at"] : r["at"] + len(r["bits"])] |= np.frombuffer(r["bits"], dtype=np.uint8)
    return Bloom(bits, hashes, whole.tobytes())


def may_contain(key: str | Column, bloom: Bloom) -> Column:
    """False only for keys that were never added."""

    @F.arrow_udf("boolean")
    def probe(keys: pa.Array) -> pa.Array:
        return pa.array(bloom.may_contain([x or b"" for x in keys.to_pylist()]), pa.bool_())

    column = F.col(key) if isinstance(key, str) else key
    return probe(F.coalesce(column.cast("binary"), F.lit(b"")))


def semi_join(df: DataFrame, others: DataFrame, key: str, rate: float = 0.01) -> DataFrame:
    """df's rows whose key is among the others', after a pass of the filter: a left semi join of what it lets through."""
    return df.where(may_contain(key, build(others, key, rate))).join(others.select(key).distinct(), key, "left_semi")
