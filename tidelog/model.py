"""Schema, options and errors of the changelog engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

KEY_LIMIT = 65_535
NODE_BYTES, LOG_HEADER, ENTRY_HEADER, BLOCK_BYTES = 88, 19, 15, 4_096

#: Larger (gen, seq) is newer. ts_nanos is carried along and never decides.
MUTATION = StructType(
    [
        StructField("key", BinaryType(), False),
        StructField("value", BinaryType(), True),
        StructField("ts_nanos", LongType(), False),
        StructField("tombstone", BooleanType(), False),
        StructField("seq", LongType(), False),
        StructField("gen", LongType(), False),
    ]
)


@dataclass(frozen=True)
class TableOptions:
    """memtable_bytes: pending bytes at which apply() flushes; compaction_threshold: runs at which flush() compacts; grace_versions: manifest versions for
    which retired files stay; pushed_keys: the most keys of a lookup that go into the scan's filter; broadcast_bytes: the most bytes of keys that a lookup
    may broadcast; file_bytes: of a run's files, about; background: flushes and compactions that writes bring about run in a thread of their own."""

    memtable_bytes: int = 4 << 20
    compaction_threshold: int = 4
    auto_flush: bool = True
    auto_compact: bool = True
    grace_versions: int = 8
    pushed_keys: int = 200
    broadcast_bytes: int = 16 << 20
    file_bytes: int = 128 << 20
    bloom_fpp: float = 0.01
    background: bool = False

    def __post_init__(self):
        if self.memtable_bytes <= 0:
            object.__setattr__(self, "memtable_bytes", 4 << 20)
        if self.compaction_threshold <= 0:
            object.__setattr__(self, "compaction_threshold", 4)


class KeyNotFound(KeyError):
    """No live value under the key: never written, or deleted."""


class TableClosed(RuntimeError):
    """The table was closed."""


class CommitConflict(RuntimeError):
    """Another writer published first, and what this one planned no longer holds."""


class CorruptFile(ValueError):
    """A binary file can't be read as what it should be."""
