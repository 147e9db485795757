import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog import repl
from tidelog.functions.codec import crc32c, crc32c_many, decode_entries, encode_entries, pack_entry, unpack_entries
from tidelog.functions.sizes import bloom_bits
from tidelog.model import CorruptFile, TableOptions
from tidelog.operators import membership
from tidelog.operators.membership import Bloom
from tidelog.sources import wire
from tidelog.streaming import live
from tidelog.table import open_table


def log(n, first=0):
    return [wire.log_record(b"key-%06d" % i, b"value-%06d" % i, i + 1, False) for i in range(first, first + n)]


def test_checksum():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0
    parts = [b"", b"a", b"abc" * 100, b"123456789"]
    assert crc32c_many(parts).tolist() == [crc32c(x) for x in parts]
    record = wire.log_record(b"hello", b"world", 1, False)
    assert len(record) == 29 and struct.unpack_from("<I", record)[0] == crc32c(record[4:])


@pytest.mark.parametrize(
    ("data", "records", "valid"),
    [
        (b"", 0, 0),
        (b"".join(log(500)), 500, 500 * 41),
        (b"".join(log(10)) + b"0123456789", 10, 410),
        (b"".join(log(5)) + struct.pack("<IQBHI", 0, 0, 0, 100, 200) + bytes(50), 5, 205),
        (b"".join(log(5)) + struct.pack("<IQBHI", 0, 0, 0, 1, 0xFFFFFFFF), 5, 205),
    ],
)
def test_valid_prefix(data, records, valid):
    rows, kept = wire.split_log(data)
    assert (len(rows), kept) == (records, valid)
    assert [r[0] for r in rows[:3]] == [b"key-%06d" % i for i in range(min(3, records))]


def test_bad_checksum_ends_the_log():
    data = bytearray(b"".join(log(8)))
    data[7 * 41 + 19 + 9] ^= 0xFF
    assert len(wire.split_log(bytes(data))[0]) == 7
    data[3 * 41 + 30] ^= 1  # in the middle: all behind goes
    assert wire.split_log(bytes(data))[1] == 3 * 41


def test_log_files(spark, tmp_path):
    (tmp_path / "1.wal").write_bytes(b"".join(log(5)) + b"torn")
    (tmp_path / "2.wal").write_bytes(wire.log_record(b"key-000001", None, 9, True) + wire.log_record(b"big", b"V" * 100_000, 10, False))
    got = wire.read_log(spark, str(tmp_path))
    assert got.count() == 7 and {r[0] for r in got.select("dropped_bytes").distinct().collect()} == {0, 4}
    seen = {bytes(r["key"]) for r in wire.replay(spark, str(tmp_path)).collect()}
    assert seen == {b"big", *(b"key-%06d" % i for i in (0, 2, 3, 4))}
    wire.write_log(got.drop("file", "dropped_bytes").where("seq < 3"), f"file://{tmp_path}/out/3.wal")
    assert wire.read_log(spark, str(tmp_path / "out")).count() == 5
    more = spark.createDataFrame([(bytearray(b"k"), bytearray(x), 1, False, 0) for x in (b"old",)], "key binary, value binary, ts_nanos bigint, tombstone boolean, seq bigint")
    for x in (b"old", b"new"):  # what is appended later is newer
        path = wire.append_log(more.withColumn("value", F.lit(bytearray(x))), f"file://{tmp_path}/appended")
    assert path.endswith("/000002.wal") and [bytes(r["value"]) for r in wire.replay(spark, str(tmp_path / "appended")).collect()] == [b"new"]


def test_log_in_parts(spark, tmp_path, monkeypatch):
    """The executors write a log as parts, which together are its bytes; no row passes through the driver, and no task reads it all."""
    monkeypatch.setattr(wire, "PART_BYTES", 1 << 17)
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    n = 40_000
    rows = spark.range(n, 0, -1, 7).select(
        F.format_string("key-%06d", F.col("id") - 1).cast("binary").alias("key"),
        F.when(F.col("id") % 10 != 0, F.format_string("value-%06d", F.col("id") - 1).cast("binary")).alias("value"),
        F.col("id").alias("ts_nanos"),
        (F.col("id") % 10 == 0).alias("tombstone"),
        F.col("id").alias("seq"),
    )
    expected = [wire.log_record(b"key-%06d" % (i - 1), None if i % 10 == 0 else b"value-%06d" % (i - 1), i, i % 10 == 0) for i in range(1, n + 1)]
    path = tmp_path / "logs" / "000001.wal"
    wire.write_log(rows, f"file://{path}")
    parts = sorted(path.glob("*.part"))
    assert len(parts) > 4 and b"".join(x.read_bytes() for x in parts) == b"".join(expected)
    assert all(wire.split_log(x.read_bytes())[1] == x.stat().st_size for x in parts) and sorted(x.name for x in path.parent.iterdir()) == [path.name]
    for place in (path, path.parent):
        got = wire.read_log(spark, str(place))
        seen = got.select("seq", "ts_nanos", "file", "dropped_bytes", F.spark_partition_id().alias("task")).collect()
        assert sorted((r[0], r[1]) for r in seen) == [(i, i + 1) for i in range(n)]
        assert {r[2].rpartition("/")[2] for r in seen} == {path.name} and {r[3] for r in seen} == {0} and len({r[4] for r in seen}) > 1
    assert wire.replay(spark, str(path.parent)).count() == n - n // 10


def test_parts_of_a_log_have_one_valid_prefix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wire, "PART_BYTES", 1 << 16)
    rows = spark.range(0, 20_000, 1, 4).selectExpr("cast(id as string) as k", "id as ts_nanos", "false as tombstone", "id as seq").selectExpr("cast(k as binary) as key", "cast(k as binary) as value", "ts_nanos", "tombstone", "seq")
    path = tmp_path / "logs" / "000001.wal"
    wire.write_log(rows, f"file://{path}")
    parts = sorted(path.glob("*.part"))
    sizes, data = [x.stat().st_size for x in parts], parts[1].read_bytes()
    assert len(parts) > 4
    before = len(wire.split_log(parts[0].read_bytes())[0])
    found = wire.split_log(data)[0]
    for x in path.glob(".*.crc"):  # the file system would refuse what is changed below
        x.unlink()

    def state():
        seen = wire.read_log(spark, str(path.parent)).select("seq", "dropped_bytes").collect()
        return len(seen), max(r[0] for r in seen) + 1, {r[1] for r in seen}

    at = found[10][4]
    parts[1].write_bytes(data[: at + 20] + bytes([data[at + 20] ^ 1]) + data[at + 21 :])  # a bad checksum: all parts behind go, too
    assert state() == (before + 10, before + 10, {sum(sizes[1:]) - at})
    parts[1].unlink()  # so does a missing part
    assert state() == (before, before, {sum(sizes[2:])})
    (path.parent / "000002.wal").write_bytes(b"".join(log(3)))  # another log is not concerned
    assert state()[0] == before + 3
    assert wire.append_log(rows.limit(5), f"file://{path.parent}").endswith("/000003.wal")
    assert state()[0] == before + 8
    wire.write_log(rows.where("seq < 7"), f"file://{path}")  # in place of what was there
    assert wire.read_log(spark, str(path)).count() == 7
    wire.write_log(rows.where("false"), f"file://{path}")
    assert wire.read_log(spark, str(path)).count() == 0 and [x.read_bytes() for x in path.glob("*.part")] == [b""]
    wire.write_log(rows.where("seq < 4"), f"file://{path.parent}/000002.wal")
    assert wire.read_log(spark, str(path.parent)).count() == 9
    with pytest.raises(FileExistsError):
        wire.write_log(rows, f"file://{path.parent}")
    assert sorted(x.name for x in path.parent.iterdir() if x.suffix != ".crc") == ["000001.wal", "000002.wal", "000003.wal"]


def test_log_limits():
    assert len(wire.log_record(b"k", b"v", 0, False)) == 21
    with pytest.raises(ValueError, match="65535"):
        wire.log_record(bytes(65_536), b"v", 0, False)
    assert wire.split_log(wire.log_record(b"K" * 65_535, b"V" * 1000, 0, False))[0][0][1] == b"V" * 1000


def entries(n, value=lambda i: b"value-%06d" % i):
    return [(b"key-%06d" % i, None if i % 10 == 9 else value(i), i + 1, i % 10 == 9) for i in range(n)]


def test_runs():
    whole = [(k, v or b"v" * 12, ts, False) for k, v, ts, _ in entries(500)]
    assert len(wire.run_index(wire.pack_run(whole))) == 5
    large = wire.pack_run([(b"big-%04d" % i, bytes(j % 256 for j in range(2048)), i + 1, False) for i in range(50)])
    assert len(wire.run_index(large)) == 50 and len(list(wire.run_entries(large))) == 50
    assert list(wire.run_entries(wire.pack_run(entries(1000)))) == entries(1000)
    assert list(wire.run_entries(wire.pack_run([]))) == []
    huge = [(b"k", b"x" * 10_000, 1, False), (b"l", b"y", 2, False)]
    assert list(wire.run_entries(wire.pack_run(huge))) == huge
    broken = bytearray(wire.pack_run(entries(10)))
    broken[-8:] = b"\xff" * 8
    with pytest.raises(CorruptFile, match="magic"):
        list(wire.run_entries(bytes(broken)))
    with pytest.raises(CorruptFile):
        list(wire.run_entries(b"short"))


def test_run_files(spark, tmp_path):
    (tmp_path / "a.sst").write_bytes(wire.pack_run(entries(300)))
    got = wire.read_run(spark, str(tmp_path / "a.sst"))
    assert got.count() == 300 and got.where("tombstone").where("value is not null").count() == 0
    for files in (1, 3):
        path = tmp_path / f"b{files}.sst"
        wire.write_run(got, f"file://{path}", files)
        parts = sorted(path.glob("part-*"))
        assert len(parts) == files and [e for x in parts for e in wire.run_entries(x.read_bytes())] == entries(300)
    assert parts[0].read_bytes() == wire.pack_run(list(wire.run_entries(parts[0].read_bytes())))
    keys = [b"key-000007", b"key-000299", b"absent", b""]
    assert {bytes(r["key"]) for r in wire.read_run(spark, str(path), keys).collect()} == set(keys[:2])
    index = wire.read_index(spark, str(tmp_path / "b1.sst"))
    assert index.count() == len(wire.run_index((tmp_path / "a.sst").read_bytes())) and bytes(index.where("block = 0").first()["first_key"]) == b"key-000000"
    wire.write_run(got.where("false"), f"file://{tmp_path}/none.sst")
    assert wire.read_run(spark, str(tmp_path / "none.sst")).count() == 0 and wire.read_run(spark, str(tmp_path / "none.sst"), keys).count() == 0


def test_run_get_decodes_single_blocks():
    data = wire.pack_run(entries(3_000))
    assert len(wire.run_index(data)) > 10
    for k in (0, 1, 1_499, 2_999):
        assert list(wire.run_get(data, [entries(3_000)[k][0], b"none", b"zzz"])) == [entries(3_000)[k]]
    assert list(wire.run_get(data, [])) == [] and list(wire.run_get(wire.pack_run([]), [b"a"])) == []


def test_entries(spark):
    rows = [(b"key-1", b"val-1", 1, False), (b"key-2", None, 2, True), (b"key-3", b"", -3, False)]
    packed = b"".join(pack_entry(*r) for r in rows)
    assert list(unpack_entries(packed)) == rows and len(pack_entry(b"hello", b"world12345", 100, False)) == 30
    for cut in (3, 15, len(packed) - 1):
        with pytest.raises(CorruptFile):
            list(unpack_entries(packed[:cut] if cut != 15 else packed[:16]))
    df = spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), t, d) for k, v, t, d in rows], "key binary, value binary, ts_nanos bigint, tombstone boolean")
    got = decode_entries(encode_entries(df)).orderBy("ts_nanos").collect()
    assert [(bytes(r[0]), None if r[1] is None else bytes(r[1]), r[2], r[3]) for r in got] == sorted(rows, key=lambda r: r[2])


def test_bloom():
    assert bloom_bits(100_000) == (958_506, 7) and bloom_bits(1) == (10, 7) and bloom_bits(0) == (10, 7)
    keys = [b"bloom-%08d" % i for i in range(20_000)]
    made = Bloom.of(keys)
    assert made.may_contain(keys).all()
    assert made.may_contain([b"absent-%08d" % i for i in range(20_000)]).mean() <= 0.02
    again = Bloom.load(made.dump())
    assert again == made and again.may_contain(keys[:50]).all()
    assert not Bloom.of([]).may_contain([b"key-0000"]).any() and Bloom.of([b"only-key"]).may_contain([b"only-key"]).all()
    for bad in (b"", made.dump()[:-1], struct.pack("<IB", 0, 1)):
        with pytest.raises(CorruptFile):
            Bloom.load(bad)
    assert membership.fnv1a([b"", b"a"]).tolist() == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C]


def test_bloom_of_a_column(spark):
    df = spark.range(3000).selectExpr("cast(id as string) as key")
    built = membership.build(df, "key")
    assert built == Bloom.of([str(i).encode() for i in range(3000)])
    assert membership.semi_join(spark.range(5000).selectExpr("cast(id as string) as key"), df, "key").count() == 3000
    assert df.where(~membership.may_contain("key", built)).count() == 0


def test_streaming_state(spark, tmp_path):
    schema = "k string, n bigint, gone boolean"
    (tmp_path / "in").mkdir()
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 1, False)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([("a", 3, True), ("b", 0, False)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    spark.createDataFrame([("a", 1, False)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "3"))  # older than the delete
    view = live.changes(source(), ["k"], "n")
    view.writeStream.outputMode("update").format("memory").queryName("changes_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("changes_out").collect()) == [("a", 2, False), ("a", 3, True), ("b", 1, False)]
    whole = live.live_aggregate(source(), ["k"], "n", "gone")
    whole.writeStream.outputMode("complete").format("memory").queryName("live_out").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("live_out").select("k", "n").collect()] == [("b", 1)]


def test_shell(spark, tmp_path):
    table = open_table(spark, str(tmp_path / "t"), TableOptions(auto_flush=False))
    lines = "put name  Ada   Lovelace\n\nGET name extra\nget nobody\ndelete name\nget name\nput x\nget\ndelete\nstats\nhelp\nfly\nexit\nput never seen\n"
    out = io.StringIO()
    repl.session(table, io.StringIO(lines), out)
    assert out.getvalue().splitlines() == [
        "OK",
        "Ada   Lovelace",
        "(nil)",
        "OK",
        "(nil)",
        "usage: put <key> <value>",
        "usage: get <key>",
        "usage: delete <key>",
        "runs: 0",
        "pending segments: 2",
        repl.HELP,
        "unknown command: fly",
    ]


def test_fnv_wraps():
    assert membership.fnv1a([b"foobar"]).astype(np.uint64)[0] == 0x85944171F73967E8
