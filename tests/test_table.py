import random

import pytest
from pyspark.sql import functions as F

from tidelog.model import CommitConflict, KeyNotFound, TableClosed, TableOptions
from tidelog.table import key_column, open_table, value_column

QUIET = TableOptions(auto_flush=False, auto_compact=False)


def rows(pattern_key, pattern_value, n):
    return [((pattern_key % i).encode(), (pattern_value % i).encode()) for i in range(n)]


def live(table):
    return {bytes(r["key"]): bytes(r["value"]) for r in table.live().collect()}


def test_put_get_overwrite_delete(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), QUIET)
    t.put([(b"k", b"v1"), (b"e", b""), (b"", b"empty key")])
    assert t.get(b"k") == b"v1" and t.get(b"e") == b"" and t.get(b"") == b"empty key"
    t.put([(b"k", b"v2")])
    assert t.get(b"k") == b"v2"
    t.delete([b"k", b"never there"])
    for key in (b"k", b"never there", b"absent"):
        with pytest.raises(KeyNotFound):
            t.get(key)
    t.put([(b"k", b"again")])
    assert t.get(b"k") == b"again"


def test_a_batch_resolves_by_its_order(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), QUIET)
    t.put([(b"k", b"first"), (b"k", b"second")])
    assert t.get(b"k") == b"second"
    df = spark.createDataFrame([(bytearray(b"k"), bytearray(b"late"), False, 9), (bytearray(b"k"), bytearray(b"early"), False, 3)], "key binary, value binary, tombstone boolean, n bigint")
    t.apply(df, order="n")
    assert t.get(b"k") == b"late"


def test_flush_makes_runs(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), TableOptions(memtable_bytes=4096, auto_compact=False))
    t.put(rows("flush-key-%04d", "flush-val-%04d", 200))
    assert t.stats()["runs"] == 1 and t.stats()["pending_segments"] == 0
    t.put(rows("multi-%06d", "val-%06d", 100))
    assert t.stats()["runs"] == 2 and len(live(t)) == 300
    assert t.stats()["run_min_keys"] == [b"flush-key-0000", b"multi-000000"]
    assert not t.flush()


def test_delete_shadows_runs_and_compaction_purges(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), QUIET)
    t.put(rows("key-%04d", "val-%04d", 200))
    t.flush()
    t.delete([b"key-0050"])
    t.flush()
    with pytest.raises(KeyNotFound):
        t.get(b"key-0050")
    keys = spark.createDataFrame([("key-0050",), ("key-0051",), ("no",)], "key string")
    assert {bytes(r[0]): r[1] for r in t.status(keys).collect()} == {b"key-0050": "deleted", b"key-0051": "live", b"no": "absent"}
    assert not t.compact() and t.compact(force=True)
    assert t.versions().count() == 199 and t.stats()["runs"] == 1
    assert {r[1] for r in t.status(keys.limit(1)).collect()} == {"absent"}
    t.put([(b"key-0050", b"back")])
    t.flush()
    t.compact(force=True)
    assert t.get(b"key-0050") == b"back" and len(live(t)) == 200


def test_all_tombstones_leave_no_run(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), QUIET)
    t.put([(b"a", b"1")])
    t.delete([b"a"])
    t.flush()
    t.compact(force=True)
    assert t.stats()["runs"] == 0 and live(t) == {}


def test_threshold_compacts(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), TableOptions(memtable_bytes=1, compaction_threshold=3))
    for i in range(3):
        t.put([(b"k", b"%d" % i)])
    assert t.stats()["runs"] == 1 and t.get(b"k") == b"2"


def test_reopen_finds_segments_and_runs(spark, tmp_path):
    path = str(tmp_path / "t")
    t = open_table(spark, path, QUIET)
    t.put(rows("k-%04d", "v-%04d", 60))
    t.flush()
    t.put(rows("rec-%04d", "val-%04d", 10))
    t.close()
    t.close()
    with pytest.raises(TableClosed):
        t.put([(b"a", b"b")])
    again = open_table(spark, path, QUIET)
    assert len(live(again)) == 70 and again.get(b"rec-0009") == b"val-0009"
    again.flush()
    assert again.stats()["runs"] == 2


def test_newer_arrival_with_older_timestamp(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), QUIET)
    for ts, value in ((200, b"first"), (100, b"second")):
        t.apply(spark.createDataFrame([(bytearray(b"k"), bytearray(value), False, ts)], "key binary, value binary, tombstone boolean, ts_nanos bigint"))
    assert t.get(b"k") == b"second"


def test_key_limit(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), QUIET)
    t.put([(b"K" * 65_535, b"V" * (1 << 20))])
    assert len(t.get(b"K" * 65_535)) == 1 << 20
    with pytest.raises(Exception, match="65535"):
        t.put([(bytes(65_536), b"v")])
    assert t.stats()["pending_segments"] == 1  # nothing of the failed batch is seen


def test_concurrent_writers_both_commit(spark, tmp_path):
    a, b = (open_table(spark, str(tmp_path / "t"), QUIET) for _ in range(2))
    a.put([(b"a", b"1")])
    b.put([(b"b", b"2")])
    assert live(a) == live(b) == {b"a": b"1", b"b": b"2"}
    stale = a.store.read()
    b.put([(b"c", b"3")])
    with pytest.raises(CommitConflict):
        a.store.publish(stale)


def test_flush_during_compaction_stays_newer(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), QUIET)
    for value in (b"1", b"2"):
        t.put([(b"k", value)])
        t.flush()
    other = open_table(spark, str(tmp_path / "t"), QUIET)
    inner = t._sorted_run

    def meanwhile(parts, purge):
        run = inner(parts, purge)
        other.put([(b"k", b"3")])
        other.flush()
        return run

    t._sorted_run = meanwhile
    t.compact(force=True)
    again = open_table(spark, str(tmp_path / "t"), QUIET)
    assert again.get(b"k") == b"3" and again.stats()["runs"] == 2


def test_readers_keep_their_version(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), QUIET)
    t.put([(b"a", b"1")])
    t.flush()
    view = t.live()
    t.put([(b"a", b"2")])
    t.flush()
    t.compact(force=True)
    assert bytes(view.collect()[0]["value"]) == b"1"
    assert t.vacuum() == 0 and t.vacuum(grace=0) == 4 + 5  # segments and runs, and manifests
    assert t.get(b"a") == b"2"


def test_files_outside_the_manifest_are_ignored(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), QUIET)
    t.put([(b"a", b"1")])
    (tmp_path / "t" / "runs" / "partial").mkdir(parents=True)
    (tmp_path / "t" / "runs" / "partial" / "part-0.parquet").write_bytes(b"half a file")
    (tmp_path / "t" / "manifest" / ".half").write_bytes(b"{")
    assert live(open_table(spark, str(tmp_path / "t"), QUIET)) == {b"a": b"1"}


def test_multi_get_both_ways_and_scan(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), TableOptions(auto_flush=False, pushed_keys=2))
    t.put(rows("k-%03d", "v-%03d", 50))
    t.delete([b"k-010"])
    for n in (2, 5):
        keys = spark.createDataFrame([(f"k-{i:03d}",) for i in range(9, 9 + n)], "key string")
        got = {bytes(r["key"]): r["found"] for r in t.multi_get(keys).collect()}
        assert got == {f"k-{i:03d}".encode(): i != 10 for i in range(9, 9 + n)}
    assert [bytes(r["key"]) for r in t.scan(b"k-009", b"k-012").collect()] == [b"k-009", b"k-011"]
    assert t.scan().count() == 49 and t.scan(b"z").count() == 0


def test_absent_keys_read_no_rows_of_a_run(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), QUIET)
    t.put(rows("key-%06d", "value-%06d", 200))
    t.flush()
    plan = t.versions().where(F.col("key") == F.lit(bytearray(b"key-000007")))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_single_run_is_read_without_a_shuffle(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), QUIET)
    t.put(rows("a-%03d", "v-%03d", 40))
    t.flush()
    assert "Exchange" not in plan_of(t.live()) and "Sort" not in plan_of(t.live())
    t.put(rows("b-%03d", "v-%03d", 40))  # another key range
    t.flush()
    assert "Exchange" not in plan_of(t.live()) and t.live().count() == 80
    t.delete([b"a-005"])
    assert "Exchange" in plan_of(t.live()) and t.live().count() == 79


def test_lookups_open_the_files_of_their_ranges(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), TableOptions(auto_flush=False, auto_compact=False, file_bytes=1_000))
    t.put(rows("key-%06d", "value-%06d", 400))
    t.delete([b"key-000100"])
    t.flush()
    t.compact(force=True)
    (run,) = t.manifest.runs
    assert run.ranges and spark.read.parquet(run.ranges).count() > 5
    assert t.get(b"key-000007") == b"value-000007" and live(t)[b"key-000399"] == b"value-000399" and len(live(t)) == 399
    with pytest.raises(KeyNotFound):
        t.get(b"key-000100")
    some = t._lookup((run,), [b"key-000007", b"key-000350", b"zzz"])
    assert 1 <= len(some.inputFiles()) <= 2 and "Exchange" not in plan_of(some)
    keys = spark.createDataFrame([("key-000007",), ("key-000350",), ("key-000100",), ("zzz",)], "key string")
    found = t.multi_get(keys)
    assert {bytes(r["key"]): r["found"] for r in found.collect()} == {b"key-000007": True, b"key-000350": True, b"key-000100": False, b"zzz": False}
    assert "In(key" in plan_of(found) or "In([key" in plan_of(found)
    assert {bytes(r["key"]): r["status"] for r in t.status(keys).collect()}[b"key-000100"] == "absent"
    assert t.successor(b"key-000099") == (b"key-000101", b"value-000101")
    with pytest.raises(KeyNotFound):
        t.successor(b"key-000399")


def test_vacuum_takes_orphans_and_old_manifests(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), QUIET)
    for k in range(4):
        t.put([(b"a", b"%d" % k)])
    t.flush()
    (tmp_path / "t" / "segments" / "orphan").mkdir()
    assert t.vacuum(grace=0) == 4 + 5 and (tmp_path / "t" / "segments" / "orphan").exists()
    assert t.vacuum(grace=0, orphan_seconds=-60) == 1 and not (tmp_path / "t" / "segments" / "orphan").exists()
    assert t.store.versions() == [t.manifest.version] and t.get(b"a") == b"3" and t.vacuum(grace=0, orphan_seconds=-60) == 0


def test_maintenance_in_the_background(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), TableOptions(memtable_bytes=1, compaction_threshold=2, background=True))
    for k in range(4):
        t.put([(b"k%d" % k, b"v")])
    t.wait()
    assert len(t._fresh().segments) == 0 and live(t) == {b"k%d" % k: b"v" for k in range(4)}
    t.close()
    t.close()


def test_stream_batches_apply_once(spark, tmp_path):
    t = open_table(spark, str(tmp_path / "t"), QUIET)
    one = spark.createDataFrame([(bytearray(b"k"), bytearray(b"1"), False)], "key binary, value binary, tombstone boolean")
    assert t.apply(one, stream=("s", 0)) and not t.apply(one, stream=("s", 0))
    (tmp_path / "in").mkdir()
    one.write.parquet(str(tmp_path / "in" / "a"))
    source = lambda: spark.readStream.schema(one.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    t.ingest_stream(source(), str(tmp_path / "check"), name="files", available_now=True).awaitTermination()
    spark.createDataFrame([(bytearray(b"k"), None, True)], one.schema).write.parquet(str(tmp_path / "in" / "b"))
    t.ingest_stream(source(), str(tmp_path / "check"), name="files", available_now=True).awaitTermination()
    assert live(t) == {} and t.versions().count() == 3


def test_typed_keys(spark):
    df = spark.createDataFrame([("1", "23"), ("12", "3")], "a string, b string").select(key_column("a", "b").alias("k"), value_column("a", "b").alias("v"))
    got = df.collect()
    assert got[0]["k"] != got[1]["k"] and bytes(got[0]["v"]) == b'{"a":"1","b":"23"}'


def test_random_history_is_a_dictionary(spark, tmp_path):
    chance = random.Random(11)
    t, want = open_table(spark, str(tmp_path / "t"), QUIET), {}
    for _ in range(8):
        batch = [(b"k%d" % chance.randrange(12), None if chance.random() < 0.3 else b"%d" % chance.randrange(99)) for _ in range(chance.randrange(1, 9))]
        t.apply(t._frame((k, v, v is None) for k, v in batch), order="ord")
        for k, v in batch:
            want.pop(k, None) if v is None else want.__setitem__(k, v)
        if chance.random() < 0.4:
            t.flush()
        if chance.random() < 0.2:
            t.compact(force=True)
    assert live(t) == want
