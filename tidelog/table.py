"""A keyed table: pending segments and sorted runs under a manifest, resolved by last writer wins.

A batch of mutations becomes one segment (its Parquet commit is the durability point), pending until flush() resolves the pending
ones into a sorted run. compact() merges all runs and purges tombstones, which is only right since the oldest run is among
them. Reads pin a manifest version and resolve by (gen, seq).

A run holds each key once, so parts are resolved only where their key ranges meet: a run that meets no other part is read as it is, without
a shuffle. The key range of every file of a run is listed beside it, and lookups open those files alone that may hold a key.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.sizes import byte_length, log_bytes, memory_bytes
from .manifest import Manifest, Part, Store
from .model import BLOCK_BYTES, KEY_LIMIT, MUTATION, CommitConflict, KeyNotFound, TableClosed, TableOptions
from .operators import resolve

_INPUT = "key binary, value binary, tombstone boolean, ord bigint"
_ORDER = ("gen", "seq")


def open_table(spark: SparkSession, path: str, options: TableOptions | None = None) -> KeyedTable:
    """The table at a path, made if it isn't there. All committed batches are in it."""
    return KeyedTable(spark, path, options or TableOptions())


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, options: TableOptions):
        self.spark, self.options, self._closed = spark, options, False
        self.store = Store(spark, path)
        self.manifest = self.store.read()
        self._worker = ThreadPoolExecutor(1, thread_name_prefix="maintenance") if options.background else None
        self._work: list[Future] = []

    # ------------------------------------------------------------ writes

    def put(self, rows: DataFrame | Iterable[tuple[bytes, bytes]], order: str | None = None) -> None:
        """Upserts (key, value)."""
        self.apply(self._frame(((k, v, False) for k, v in rows)) if not isinstance(rows, DataFrame) else rows.withColumn("tombstone", F.lit(False)), order if isinstance(rows, DataFrame) else "ord")

    def delete(self, keys: DataFrame | Iterable[bytes], order: str | None = None) -> None:
        """Tombstones, whether the keys are there or not."""
        frame = keys.select("key", *([order] if order else [])) if isinstance(keys, DataFrame) else self._frame((k, None, True) for k in keys)
        self.apply(frame.withColumn("value", F.lit(None).cast("binary")).withColumn("tombstone", F.lit(True)), order if isinstance(keys, DataFrame) else "ord")

    def apply(self, mutations: DataFrame, order: str | None = None, batch_id: str | None = None, stream: tuple[str, int] | None = None) -> bool:
        """One atomic batch of key, value, tombstone and perhaps ts_nanos.

        Later rows win by the long column `order`. Without one, of a key that repeats in the batch the row that sorts last by
        (tombstone, value) wins. stream: (name, batch number); a batch of a number seen before is skipped. Returns whether it was applied.
        """
        self._writable()
        path = self.store.fresh("segments")
        now = self._fresh()
        if stream and dict(now.batches).get(stream[0], -1) >= stream[1]:
            return False
        key = F.coalesce(F.col("key").cast("binary"), F.lit(b""))
        value = F.when(F.col("tombstone"), F.lit(None).cast("binary")).otherwise(F.coalesce(F.col("value").cast("binary"), F.lit(b"")))
        checked = F.when(F.octet_length(key) > KEY_LIMIT, F.raise_error(F.lit(f"a key has more than {KEY_LIMIT} bytes")).cast("binary")).otherwise(key)
        stamp = F.col("ts_nanos").cast("long") if "ts_nanos" in mutations.columns else F.lit(time.time_ns())
        seq = F.lit(0).cast("long") if order is None else F.col(order).cast("long")
        rows = mutations.select(checked.alias("key"), value.alias("value"), stamp.alias("ts_nanos"), F.col("tombstone").alias("tombstone"), F.coalesce(seq, F.lit(0)).alias("seq"))
        part = self._write(rows, path, now.next_gen, batch_id)
        if part is None and not stream:
            return False

        def add(m: Manifest) -> Manifest:
            if stream and dict(m.batches).get(stream[0], -1) >= stream[1]:
                raise CommitConflict("the batch was applied meanwhile")
            new = replace(m, batches=tuple((dict(m.batches) | {stream[0]: stream[1]}).items())) if stream else m
            if part is None:
                return new
            return replace(new, segments=(*m.segments, replace(part, gen=m.next_gen)), next_gen=m.next_gen + 1, next_seq=max(m.next_seq, part.max_seq + 1))

        self._commit(add)
        if self.options.auto_flush and sum(x.bytes for x in self.manifest.segments) >= self.options.memtable_bytes:
            if self._worker:
                self._work = [x for x in self._work if not x.done() or x.exception()] + [self._worker.submit(self.flush)]
            else:
                self.flush()
        return True

    def _frame(self, rows: Iterable[tuple]) -> DataFrame:
        return self.spark.createDataFrame([(bytearray(k or b""), None if v is None else bytearray(v), t, i) for i, (k, v, t) in enumerate(rows)], _INPUT)

    def _write(self, rows: DataFrame, path: str, gen: int, batch_id: str | None = None, bloom: bool = False) -> Part | None:
        """The rows as Parquet, measured in the same pass; None if there are none."""
        seen = Observation()
        measured = rows.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.sum(memory_bytes("key", "value")).alias("bytes"),
            F.sum(log_bytes("key", "value")).alias("log_bytes"),
            F.sum(F.col("tombstone").cast("int")).alias("tombstones"),
            F.hex(F.min("key")).alias("min_key"),
            F.hex(F.max("key")).alias("max_key"),
            F.min("seq").alias("min_seq"),
            F.max("seq").alias("max_seq"),
        )
        writer = measured.write
        if bloom:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.options.bloom_fpp))
        writer.parquet(path)
        found = seen.get
        if not found["rows"]:
            self.store.remove(path)
            return None
        return Part(gen=gen, path=path, batch_id=batch_id, **{k: v for k, v in found.items()})

    # ------------------------------------------------------------ maintenance

    def flush(self) -> bool:
        """Pending segments into one sorted run, the newest version of each key, tombstones kept. Returns whether there was anything."""
        self._writable()
        now = self._fresh()
        pending = now.segments
        if not pending:
            return False
        run = self._sorted_run(pending, purge=False)

        def swap(m: Manifest) -> Manifest:
            if m.segments[: len(pending)] != pending:
                raise CommitConflict("the segments were flushed meanwhile")
            return replace(m, segments=m.segments[len(pending) :], runs=(*m.runs, *([run] if run else [])), retired=m.retired + tuple((x.path, m.version + 1) for x in pending))

        self._commit(swap)
        if self.options.auto_compact:
            self.compact()
        return True

    def compact(self, force: bool = False) -> bool:
        """All runs into one, without tombstones, if there are as many as the threshold. Returns whether it was done.

        Runs flushed meanwhile stay newer, as the result has the generation of its newest input.
        """
        self._writable()
        inputs = self._fresh().runs
        if len(inputs) < (1 if force else self.options.compaction_threshold) or not inputs:
            return False
        run = self._sorted_run(inputs, purge=True)

        def swap(m: Manifest) -> Manifest:
            if m.runs[: len(inputs)] != inputs:
                raise CommitConflict("the runs are no longer the oldest ones")
            return replace(m, runs=(*([run] if run else []), *m.runs[len(inputs) :]), retired=m.retired + tuple((p, m.version + 1) for x in inputs for p in (x.path, x.ranges) if p))

        self._commit(swap)
        return True

    def _sorted_run(self, parts: tuple[Part, ...], purge: bool) -> Part | None:
        """The newest versions of the parts' keys, sorted. Rows are dealt out by key range first, which serves resolution and order alike: one shuffle,
        and the ranges' bounds come from a pass over the keys alone."""
        files = max(1, -(-sum(x.log_bytes for x in parts) // self.options.file_bytes))
        rows = self._read(parts)
        if not purge:  # one of the segments may hold very many versions of a key: these are reduced before the shuffle
            newest = resolve.latest(rows, "key", _ORDER)
            ordered = newest.repartitionByRange(files, "key") if files > 1 else newest.coalesce(1)
        else:
            ordered = resolve.latest(rows.repartitionByRange(files, "key"), "key", _ORDER) if files > 1 else resolve.latest(rows, "key", _ORDER).coalesce(1)
        if purge:
            ordered = resolve.purge(ordered)
        path = self.store.fresh("runs")
        part = self._write(ordered.sortWithinPartitions("key").select(*[f.name for f in MUTATION if f.name != "gen"]), path, max(x.gen for x in parts), bloom=True)
        if part is None or files == 1:
            return part
        ranges = self.store.fresh("ranges")
        keys = self.spark.read.schema("key binary").parquet(path).select(F.input_file_name().alias("file"), "key")
        keys.groupBy("file").agg(F.min("key").alias("lower"), F.max("key").alias("upper")).coalesce(1).write.parquet(ranges)
        return replace(part, ranges=ranges)

    def vacuum(self, grace: int | None = None, orphan_seconds: float = 86_400) -> int:
        """Removes files retired for more versions than the grace, manifests older than that, and what failed writes have left: folders
        that no kept manifest lists and that have not changed for `orphan_seconds` (longer than any write takes). Returns how many paths."""
        self._writable()
        now = self._fresh()
        grace = self.options.grace_versions if grace is None else grace
        old = [(p, v) for p, v in now.retired if now.version - v >= grace]
        if old:
            self._commit(lambda m: replace(m, retired=tuple(x for x in m.retired if x not in old)))
        now = self.manifest
        kept = [now, *(m for v in self.store.versions() if v > now.version - max(grace, 1) and (m := self.store.read(v)))]
        listed = {x for m in kept for part in (*m.segments, *m.runs) for x in (part.path, part.ranges)} | {p for p, _ in now.retired}
        gone = {p for p, _ in old}
        before = time.time() - orphan_seconds
        gone |= {p for kind in ("segments", "runs", "ranges") for p, changed in self.store.listed(kind) if p not in listed and changed < before}
        gone |= {self.store.manifest_path(v) for v in self.store.versions() if v <= now.version - max(grace, 1)}
        for path in gone:
            self.store.remove(path)
        return len(gone)

    def wait(self) -> None:
        """Until the flushes and compactions in the background are done; raises what one of them raised."""
        work, self._work = self._work, []
        for x in work:
            x.result()

    def close(self) -> None:
        """Any number of times; waits for work in the background. Pending segments stay pending; later calls, reads too, raise TableClosed."""
        if not self._closed:
            try:
                self.wait()
            finally:
                self._closed = True
                if self._worker:
                    self._worker.shutdown()

    # ------------------------------------------------------------ reads

    def versions(self) -> DataFrame:
        """All retained mutations."""
        now = self._fresh()
        return self._read((*now.runs, *now.segments))

    def live(self) -> DataFrame:
        """key, value and ts_nanos of all live keys; order by key for a scan."""
        now = self._fresh()
        return resolve.purge(self._newest((*now.runs, *now.segments))).select("key", "value", "ts_nanos")

    def scan(self, lower: bytes | None = None, upper: bytes | None = None) -> DataFrame:
        """Live rows with lower <= key < upper in key order; only parts whose key range meets the bounds are read."""
        now = self._fresh()
        parts = tuple(x for x in (*now.runs, *now.segments) if (upper is None or bytes.fromhex(x.min_key) < upper) and (lower is None or bytes.fromhex(x.max_key) >= lower))
        bounds = [] if lower is None else [F.col("key") >= F.lit(bytearray(lower))]
        bounds += [] if upper is None else [F.col("key") < F.lit(bytearray(upper))]
        within = reduce(Column.__and__, bounds) if bounds else None
        return resolve.purge(self._newest(parts, within)).select("key", "value", "ts_nanos").orderBy("key")

    def get(self, key: bytes) -> bytes:
        """The live value, from the files whose key range holds the key; in these, row groups by statistics and bloom filter."""
        now = self._fresh()
        found = resolve.purge(self._lookup((*now.runs, *now.segments), [bytes(key)])).select("value").take(1)
        if not found:
            raise KeyNotFound(key)
        return bytes(found[0]["value"])

    def successor(self, key: bytes) -> tuple[bytes, bytes]:
        """The live row of the smallest key above `key`."""
        found = self.scan(bytes(key) + b"\0").select("key", "value").limit(1).collect()
        if not found:
            raise KeyNotFound(key)
        return bytes(found[0]["key"]), bytes(found[0]["value"])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """key, value and found of every distinct key."""
        probes, rows, small = self._probed(keys)
        return resolve.multi_get(probes, rows, "key", _ORDER, broadcast=small).select("key", "value", "found")

    def status(self, keys: DataFrame) -> DataFrame:
        """key and status (live, deleted or absent); what compaction has purged is absent."""
        probes, rows, small = self._probed(keys)
        return resolve.status(probes, rows, "key", _ORDER, broadcast=small)

    def _probed(self, keys: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """(probes, rows that may answer them, may the probes be broadcast). Up to options.pushed_keys probes are filters of the scan; of more,
        the smallest and the largest are, and they are broadcast up to options.broadcast_bytes, joined by shuffle beyond."""
        probes = keys.select(F.coalesce(F.col("key").cast("binary"), F.lit(b"")).alias("key"))
        now = self._fresh()
        parts = (*now.runs, *now.segments)
        few = {bytes(r["key"]) for r in probes.distinct().limit(self.options.pushed_keys + 1).collect()}
        if len(few) <= self.options.pushed_keys:
            return probes, self._lookup(parts, sorted(few)), True
        seen = probes.agg(F.min("key").alias("lower"), F.max("key").alias("upper"), F.sum(F.octet_length("key") + 64).alias("bytes")).first()
        met = tuple(x for x in parts if bytes.fromhex(x.min_key) <= bytes(seen["upper"]) and bytes.fromhex(x.max_key) >= bytes(seen["lower"]))
        rows = self._read(met).where(F.col("key").between(F.lit(seen["lower"]), F.lit(seen["upper"])))
        return probes, rows, seen["bytes"] <= self.options.broadcast_bytes

    def _lookup(self, parts: tuple[Part, ...], keys: list[bytes]) -> DataFrame:
        """The newest versions of a few keys, from the files that may hold one of them."""
        may = lambda part: [k for k in keys if bytes.fromhex(part.min_key) <= k <= bytes.fromhex(part.max_key)]
        parts = tuple(x for x in parts if may(x))
        if not parts:
            return self._read(())
        files = {x.path: self._files(x, may(x)) for x in parts if x.ranges}
        wanted = F.col("key").isin([F.lit(bytearray(k)) for k in keys]) if len(keys) > 1 else F.col("key") == F.lit(bytearray(keys[0]))
        return self._newest(parts, wanted, files)

    def _files(self, part: Part, keys: list[bytes]) -> list[str]:
        """Of a run's files those whose key range holds one of the keys, at most two a key."""
        held = [(F.col("lower") <= F.lit(bytearray(k))) & (F.col("upper") >= F.lit(bytearray(k))) for k in keys]
        listing = self.spark.read.schema("file string, lower binary, upper binary").parquet(part.ranges)
        return sorted(r["file"] for r in listing.where(reduce(Column.__or__, held)).select("file").collect())

    def _newest(self, parts: tuple[Part, ...], within: Column | None = None, files: dict[str, list[str]] | None = None) -> DataFrame:
        """The newest version of every key (that is within), tombstones included. Parts whose key ranges don't meet are resolved apart, and a
        run alone is resolved already."""
        frames = []
        for group in _meeting(parts):
            rows = self._read(group, files)
            rows = rows if within is None else rows.where(within)
            frames.append(rows if len(group) == 1 and group[0] in self.manifest.runs else resolve.latest(rows, "key", _ORDER))
        return reduce(DataFrame.unionByName, frames) if frames else self._read(())

    def _read(self, parts: tuple[Part, ...], files: dict[str, list[str]] | None = None) -> DataFrame:
        """All rows of the parts, of some of them only the given files."""
        frames = []
        for x in parts:
            paths = (files or {}).get(x.path, [x.path])
            if paths:
                frames.append(self.spark.read.schema("key binary, value binary, ts_nanos bigint, tombstone boolean, seq bigint").parquet(*paths).withColumn("gen", F.lit(x.gen).cast("long")))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], MUTATION)

    def stats(self) -> dict:
        now = self._fresh()
        return {
            "version": now.version,
            "runs": len(now.runs),
            "pending_segments": len(now.segments),
            "memory_bytes": sum(x.bytes for x in now.segments),
            "log_bytes": sum(x.log_bytes for x in now.segments),
            "rows": sum(x.rows for x in (*now.runs, *now.segments)),
            "run_min_keys": [bytes.fromhex(x.min_key) for x in now.runs],
            "run_blocks": [-(-x.log_bytes // BLOCK_BYTES) for x in now.runs],
            "parts": [asdict(x) for x in (*now.runs, *now.segments)],
        }

    # ------------------------------------------------------------ streams

    def ingest_stream(self, stream: DataFrame, checkpoint: str, order: str | None = None, name: str = "ingest", available_now: bool = False):
        """A query that applies each micro-batch of key, value, tombstone as one commit, once, whatever is retried."""

        def sink(batch: DataFrame, number: int) -> None:
            self.apply(batch, order, batch_id=f"{name}:{number}", stream=(name, number))

        writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    # ------------------------------------------------------------ commits

    def _writable(self) -> None:
        if self._closed:
            raise TableClosed("the table is closed")

    def _fresh(self) -> Manifest:
        self._writable()
        self.manifest = self.store.read()
        return self.manifest

    def _commit(self, change, attempts: int = 20) -> None:
        """Applies `change` to the newest manifest and publishes it; if another writer was first, tries again on theirs."""
        for k in range(attempts):
            try:
                self.manifest = self.store.publish(change(self.store.read()))
                return
            except CommitConflict as e:
                if "there already" not in str(e) or k == attempts - 1:
                    raise
                time.sleep(0.01 * (k + 1))


def _meeting(parts: tuple[Part, ...]) -> list[tuple[Part, ...]]:
    """The parts in groups, so that key ranges meet only within a group."""
    groups: list[tuple[bytes, list[Part]]] = []
    for x in sorted(parts, key=lambda x: bytes.fromhex(x.min_key)):
        low, high = bytes.fromhex(x.min_key), bytes.fromhex(x.max_key)
        if groups and low <= groups[-1][0]:
            groups[-1] = (max(high, groups[-1][0]), [*groups[-1][1], x])
        else:
            groups.append((high, [x]))
    return [tuple(x) for _, x in groups]


def value_column(*columns: str) -> Column:
    """Columns as one JSON value, for tables whose values are typed rows."""
    return F.to_json(F.struct(*columns)).cast("binary")


def key_column(*columns: str) -> Column:
    """Columns as one key: each with its length before it, so that different tuples never make equal keys."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat(*[F.concat(byte_length(t).cast("string"), F.lit(":"), t) for t in texts]).cast("binary")
