import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import sizes
from tidelog.operators import resolve

ROW = "key string, value string, tombstone boolean, seq bigint, gen bigint"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def pairs(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_overwrite_and_tombstone(spark):
    df = frame(spark, [("k", "v1", False, 1, 0), ("k", "v2-longer", False, 2, 0), ("d", "val", False, 1, 0), ("d", None, True, 2, 0)])
    assert pairs(resolve.latest(df, "key", ("gen", "seq"))) == {"k": "v2-longer", "d": None}
    assert pairs(resolve.live_view(df, "key", ("gen", "seq"))) == {"k": "v2-longer"}


def test_generation_beats_sequence(spark):
    df = frame(spark, [("a", "old", False, 99, 1), ("a", "new", False, 1, 2)])
    assert pairs(resolve.latest(df, "key", ("gen", "seq"))) == {"a": "new"}


def test_revive_and_empty_value(spark):
    df = frame(spark, [("a", "1", False, 1, 0), ("a", None, True, 2, 0), ("a", "", False, 3, 0), ("gone", None, True, 1, 0)])
    assert pairs(resolve.live_view(df, "key", "seq")) == {"a": ""}


def test_merge_shadow_and_position(spark):
    newer = frame(spark, [("a", "new", False, 0, 0), ("b", None, True, 0, 0)])
    older = frame(spark, [("a", "old", False, 5, 0), ("b", "old", False, 5, 0), ("c", "old", False, 5, 0)])
    merged = {r["key"]: (r["value"], r["tombstone"]) for r in resolve.merge([newer, older]).collect()}
    assert merged == {"a": ("new", False), "b": (None, True), "c": ("old", False)}
    three = [frame(spark, [("a", x, False, 0, 0)]) for x in "123"]
    assert pairs(resolve.merge(three)) == {"a": "1"}
    assert pairs(resolve.merge([newer, older]).where("not tombstone")) == {"a": "new", "c": "old"}


def test_interleave_in_order(spark):
    odd = frame(spark, [(x, f"val-{x}1", False, 0, 0) for x in "ac"])
    even = frame(spark, [(x, f"val-{x}2", False, 0, 0) for x in "bd"])
    assert [r["key"] for r in resolve.merge([odd, even]).orderBy("key").collect()] == list("abcd")


def test_status_and_multi_get(spark):
    df = frame(spark, [("alive", "v", False, 1, 0), ("dead", "v", False, 1, 0), ("dead", None, True, 2, 0)])
    probes = spark.createDataFrame([("alive",), ("dead",), ("never",)], "key string")
    assert {r[0]: r[1] for r in resolve.status(probes, df, "key", "seq").collect()} == {"alive": "live", "dead": "deleted", "never": "absent"}
    for hint in (True, False):
        got = {r["key"]: (r["value"], r["found"]) for r in resolve.multi_get(probes, df, "key", "seq", broadcast=hint).collect()}
        assert got == {"alive": ("v", True), "dead": (None, False), "never": (None, False)}


def test_valid_prefix(spark):
    df = spark.createDataFrame([(i, i != 4) for i in range(8)], "seq bigint, ok boolean")
    assert sorted(r[0] for r in resolve.valid_prefix(df, "seq", "ok").collect()) == [0, 1, 2, 3]
    assert resolve.valid_prefix(df.where("ok"), "seq", "ok").count() == 7
    unknown = df.withColumn("ok", F.when(F.col("seq") != 2, F.col("ok")))
    assert resolve.valid_prefix(unknown, "seq", "ok").count() == 2


def test_binary_key_order(spark):
    keys = [b"\xff\x00", b"", b"\x80", b"\xff", b"\x7f", b"apple", b"apples"]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary")
    assert [bytes(r[0]) for r in df.orderBy("key").collect()] == sorted(keys)
    cases = [(b"apple", b"banana", -1), (b"banana", b"apple", 1), (b"cherry", b"cherry", 0), (b"", b"a", -1), (b"a", b"", 1), (b"", b"", 0)]
    df = spark.createDataFrame([(bytearray(a), bytearray(b), c) for a, b, c in cases], "a binary, b binary, want int")
    assert df.where(sizes.compare_keys("a", "b") != F.col("want")).count() == 0


def test_sizes(spark):
    one = spark.createDataFrame([("hello", "world12345")], "k string, v string").select(sizes.entry_bytes("k", "v"), sizes.log_bytes("k", "v"), sizes.memory_bytes("k", "v"), sizes.memory_bytes("k", F.lit(None).cast("string")))
    assert tuple(one.first()) == (30, 34, 103, 93)
    for value, want in (("val", 94), ("longer-value", 103), ("s", 92)):
        assert spark.createDataFrame([("key", value)], "k string, v string").select(sizes.memory_bytes("k", "v")).first()[0] == want
    for rows, entry, want in ((500, 37, 5), (5000, 37, 46), (50, 2071, 50)):
        assert spark.range(1, rows + 1).select(sizes.block_of("id", entry)).distinct().count() == want


def test_filters_on_keys_reach_the_scan(spark, tmp_path):
    frame(spark, [("a", "1", False, 1, 0), ("b", "2", False, 1, 0)]).write.parquet(str(tmp_path / "t"))
    view = resolve.live_view(spark.read.parquet(str(tmp_path / "t")), "key", "seq").where("key = 'a' and value = '1'")
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan and "EqualTo(value" not in plan
    assert view.count() == 1


mutations = st.lists(st.tuples(st.sampled_from("abcde"), st.one_of(st.none(), st.text("xyz", max_size=3))), max_size=30)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(mutations, st.randoms(use_true_random=False))
def test_same_as_a_dictionary(spark, log, random_):
    want = {}
    for key, value in log:
        want.pop(key, None) if value is None else want.__setitem__(key, value)
    rows = [(k, v, v is None, i % 7, i // 7) for i, (k, v) in enumerate(log)]
    random.Random(random_.random()).shuffle(rows)
    assert pairs(resolve.live_view(frame(spark, rows), "key", ("gen", "seq"))) == want


def test_places_of_wide_rows(spark):
    """Both evaluations of the ranges must agree, whatever adaptive execution makes of them."""
    from tidelog.plans.registry import _placed

    n, held = 200_000, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",)}
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.sha2(F.repeat(F.col("id").cast("string"), 20), 512).alias("wide"))
        got = _placed(df, "k")
        assert got.columns == ["k", "wide", "place"]
        assert got.agg(F.count("*"), F.sum((F.col("place") != F.col("k") + 1).cast("int")), F.countDistinct("wide")).first()[:] == (n, 0, n)
        assert _placed(df.where("false"), "k").count() == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
