"""Scalar expressions over keys and values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import BLOCK_BYTES, ENTRY_HEADER, KEY_LIMIT, LOG_HEADER, NODE_BYTES


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def byte_length(x) -> Column:
    """Bytes of a key or value; 0 for null."""
    return F.coalesce(F.octet_length(_column(x)), F.lit(0)).cast("long")


def memory_bytes(key, value) -> Column:
    return F.lit(NODE_BYTES) + byte_length(key) + byte_length(value)


def log_bytes(key, value) -> Column:
    return F.lit(LOG_HEADER) + byte_length(key) + byte_length(value)


def entry_bytes(key, value) -> Column:
    return F.lit(ENTRY_HEADER) + byte_length(key) + byte_length(value)


def key_fits(key, limit: int = KEY_LIMIT) -> Column:
    return byte_length(key) <= limit


def compare_keys(a, b) -> Column:
    """-1, 0 or 1 by unsigned bytes; null counts as the empty key."""
    a, b = (F.coalesce(_column(x).cast("binary"), F.lit(b"")) for x in (a, b))
    return F.when(a < b, -1).when(a == b, 0).otherwise(1)


def is_deleted(tombstone="tombstone") -> Column:
    return _column(tombstone)


def block_of(rank, entry: int) -> Column:
    """The block of the rank-th entry (from 1) of a run of entries of one size; an entry larger than a block has its own."""
    return F.floor((_column(rank) - 1) / F.lit(max(1, (BLOCK_BYTES - 4) // entry))).cast("long")


def bloom_bits(items: int, rate: float = 0.01) -> tuple[int, int]:
    """(bits, hash functions) of a filter for so many items."""
    items = max(1, items)
    rate = rate if 0 < rate < 1 else 0.01
    bits = max(8, math.ceil(-items * math.log(rate) / math.log(2) ** 2))
    return bits, min(30, max(1, math.ceil(bits / items * math.log(2))))
