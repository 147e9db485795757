"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table, offset + j * skip modulo the
size. The shards take turns, each claiming its next preferred slot that is free, until the table is full. A key's
hash names a slot and the slot names the shard. The shards' shares differ by one slot at most, and when a shard
leaves, few slots of the others change hands.

The table has `slots` rows whatever the data, so that bound holds for the broadcast; placement is one probe a row,
without a shuffle. A key that repeats goes to the same shard; null keys are placed as the empty text. The result
has one row per input row.

Defined cases: keys of any length are hashed whole; equal preferences can't meet, as shards claim in turns and pass over taken slots;
repeated rows are all placed, alike; an empty table gives an empty result; columns named slot or shard are replaced, all others are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, table

NAME = "op7_sharding"
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SLOTS = 65_537
MOST_SLOTS = 1_000_003


def fill(shards: tuple[str, ...], slots: int = SLOTS) -> np.ndarray:
    """The slot table: entry s is the position in `shards` of the shard that owns slot s."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots or slots > MOST_SLOTS:
        raise ValueError("shards must be distinct, at least one and no more than the slots")
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    digests = [hashlib.sha256(x.encode()).digest() for x in shards]
    place = [int.from_bytes(x[:8], "big") % slots for x in digests]
    skip = [int.from_bytes(x[8:16], "big") % (slots - 1) + 1 for x in digests]
    owner = [-1] * slots
    taken = 0
    while True:
        for k, step in enumerate(skip):
            at = place[k]
            while owner[at] >= 0:
                at = (at + step) % slots
            owner[at] = k
            place[k] = (at + step) % slots
            taken += 1
            if taken == slots:
                return np.array(owner, dtype=np.int32)


def shard(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with the columns slot and shard."""
    spark = df.sparkSession
    owner = fill(tuple(shards), slots)
    names = F.array(*[F.lit(x) for x in shards])
    at, own, held = free(df, "at", "own_slot", "owner")
    owners = spark.createDataFrame([(s, int(k)) for s, k in enumerate(owner)], f"`{own}` int, `{held}` int")
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    slot = F.pmod(F.xxhash64(text), F.lit(slots).cast("bigint")).cast("int")
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    return (
        df.select(*[F.col(f"`{c}`") for c in kept], slot.alias(at))
        .join(F.broadcast(owners), F.col(at) == F.col(own))
        .select(*[F.col(f"`{c}`") for c in kept], F.col(at).alias("slot"), names[F.col(held)].alias("shard"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents", "doc_id"), "doc_id")


ORACLE_SQL = None
