"""Queries of the changelog engine over the test tables, and their oracle SQL.

Mutation logs: events (key user_id, order event_id, tombstone event_type = 'error'), orders (key o_custkey, order o_orderdate and o_orderkey,
tombstone o_orderstatus = 'F'), lineitem (key l_orderkey and l_linenumber, order all other columns, tombstone l_returnflag = 'R').
A generation is a CHUNK of event ids.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sizes
from ..functions.codec import decode_entries, encode_entries
from ..model import TableOptions
from ..operators import membership, resolve
from ..sources import wire
from ..streaming import live
from ..table import KeyedTable, open_table

QUERIES: dict = {}
ORACLES: dict = {}
CHUNK = 250
_EVENTS = ("event_id", "user_id", "event_type", "value", "props")
_ROW = "user_id, event_id, event_type, value, props"
_NEWEST = "row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(*_EVENTS)


def _tombstone() -> Column:
    return F.col("event_type") == "error"


def _gen() -> Column:
    return F.floor(F.col("event_id") / CHUNK).cast("long")


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a temporary one does in local mode, and nothing does on a cluster."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="tidelog-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _latest(df: DataFrame) -> DataFrame:
    return resolve.latest(df, "user_id", "event_id")


_PROBES = [1, 7, 42, 99, 149, 1_000_001, -5]


def _probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _PROBES], "user_id bigint")


_PROBE_SQL = "(VALUES " + ", ".join(f"({x})" for x in _PROBES) + ") AS p(user_id)"
_LATEST_SQL = f"SELECT {_ROW} FROM events QUALIFY {_NEWEST}"
_LIVE_SQL = f"SELECT * FROM ({_LATEST_SQL}) WHERE event_type <> 'error'"

# ---------------------------------------------------------------- last writer wins


@query(_LATEST_SQL)
def lww_latest(spark, sf_dir):
    return _latest(events(spark, sf_dir))


@query(_LIVE_SQL)
def live_view(spark, sf_dir):
    return resolve.live_view(events(spark, sf_dir), "user_id", "event_id", _tombstone())


@query("SELECT * FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) WHERE o_orderstatus <> 'F'")
def live_orders(spark, sf_dir):
    return resolve.live_view(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", ("o_orderdate", "o_orderkey"), F.col("o_orderstatus") == "F")


_LINE = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_returnflag")


@query(
    "SELECT * FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY "
    + ", ".join(f"{c} DESC" for c in _LINE)
    + ") = 1) WHERE l_returnflag <> 'R'"
)
def live_lineitem(spark, sf_dir):
    return resolve.live_view(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ("l_orderkey", "l_linenumber"), _LINE, F.col("l_returnflag") == "R")


@query(f"SELECT * FROM ({_LIVE_SQL}) WHERE user_id = 7")
def point_get(spark, sf_dir):
    return resolve.live_view(events(spark, sf_dir), "user_id", "event_id", _tombstone()).where("user_id = 7")


@query(f"SELECT p.user_id, coalesce(event_id, -1) AS event_id, event_type, value, props, event_id IS NOT NULL AS found FROM {_PROBE_SQL} LEFT JOIN ({_LIVE_SQL}) USING (user_id)")
def multi_get(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("tombstone", _tombstone())
    found = resolve.multi_get(_probes(spark), rows, "user_id", "event_id", broadcast=True)  # a given list of probes
    return found.drop("tombstone").withColumn("event_id", F.coalesce("event_id", F.lit(-1).cast("long")))


@query(f"SELECT p.user_id FROM {_PROBE_SQL} ANTI JOIN ({_LIVE_SQL}) USING (user_id)")
def multi_get_miss(spark, sf_dir):
    return _probes(spark).join(live_view(spark, sf_dir), "user_id", "left_anti")


@query(f"SELECT p.user_id, CASE WHEN event_id IS NULL THEN 'absent' WHEN event_type = 'error' THEN 'deleted' ELSE 'live' END AS status FROM {_PROBE_SQL} LEFT JOIN ({_LATEST_SQL}) USING (user_id)")
def lookup_status(spark, sf_dir):
    return resolve.status(_probes(spark), events(spark, sf_dir).withColumn("tombstone", _tombstone()), "user_id", "event_id")


@query(f"SELECT {_ROW} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id // {CHUNK}, event_id DESC) = 1")
def gen_priority(spark, sf_dir):
    """Generations in reverse, so that recency and time disagree."""
    rows = events(spark, sf_dir).withColumn("gen", -_gen())
    return resolve.latest(rows, "user_id", ("gen", "event_id")).drop("gen")


def _runs(spark, sf_dir) -> list[DataFrame]:
    """Four sources, newest first, by event_id modulo 4: source 0 overrides all others."""
    return [events(spark, sf_dir).where(F.col("event_id") % 4 == k) for k in range(4)]


_MERGE_SQL = f"SELECT {_ROW} FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4, event_id DESC) = 1"


@query(f"SELECT * FROM ({_MERGE_SQL}) WHERE event_type <> 'error'")
def merge_runs(spark, sf_dir):
    return resolve.purge(resolve.merge(_runs(spark, sf_dir), "user_id", ("event_id",)), _tombstone())


@query(_MERGE_SQL)
def merge_keep_tombstones(spark, sf_dir):
    return resolve.merge(_runs(spark, sf_dir), "user_id", ("event_id",))


@query("SELECT user_id, count(*) - 1 AS shadowed FROM events GROUP BY user_id")
def shadowed_versions(spark, sf_dir):
    return resolve.shadowed(events(spark, sf_dir), "user_id")


@query(f"SELECT l.user_id FROM ({_LIVE_SQL}) l WHERE l.user_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def revive_after_delete(spark, sf_dir):
    history = events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), F.max(_tombstone()).alias("was_deleted"))
    return history.where("was_deleted and last <> 'error'").select("user_id")


@query("SELECT e.user_id, e.event_id FROM events e WHERE e.event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_id < e.event_id AND p.event_type <> 'error')")
def delete_absent(spark, sf_dir):
    """Tombstones before which nothing was put."""
    rows = events(spark, sf_dir)
    first = rows.groupBy("user_id").agg(F.min(F.when(~_tombstone(), F.col("event_id"))).alias("first_put"))
    return rows.where(_tombstone()).join(first, "user_id").where(F.col("first_put").isNull() | (F.col("event_id") < F.col("first_put"))).select("user_id", "event_id")


# ---------------------------------------------------------------- segments and sizes

_KLEN, _VLEN = "strlen(CAST(user_id AS VARCHAR))", "CASE WHEN event_type = 'error' THEN 0 ELSE strlen(props) END"
_PER_GEN = f"(SELECT *, event_id // {CHUNK} AS gen FROM events QUALIFY row_number() OVER (PARTITION BY event_id // {CHUNK}, user_id ORDER BY event_id DESC) = 1)"


def _segments(spark, sf_dir) -> DataFrame:
    return resolve.latest(events(spark, sf_dir).withColumn("gen", _gen()), ("gen", "user_id"), "event_id")


def _key() -> Column:
    return F.col("user_id").cast("string")


def _value() -> Column:
    return F.when(~_tombstone(), F.col("props"))


@query(f"SELECT gen, user_id, event_id, event_type, value, props FROM {_PER_GEN}")
def flush_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query(f"SELECT gen, CAST(sum(88 + {_KLEN} + {_VLEN}) AS BIGINT) AS memory_bytes FROM {_PER_GEN} GROUP BY gen")
def memtable_bytes(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("gen").agg(F.sum(sizes.memory_bytes(_key(), _value())).alias("memory_bytes"))


@query(f"SELECT event_id // {CHUNK} AS gen, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def memtable_len(spark, sf_dir):
    return events(spark, sf_dir).groupBy(_gen().alias("gen")).agg(F.countDistinct("user_id").alias("keys"))


@query(f"SELECT gen, CAST(sum(88 + {_KLEN} + {_VLEN}) AS BIGINT) >= 16384 AS is_full FROM {_PER_GEN} GROUP BY gen")
def memtable_full(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("gen").agg((F.sum(sizes.memory_bytes(_key(), _value())) >= 16_384).alias("is_full"))


@query(f"SELECT CAST(sum(19 + {_KLEN} + {_VLEN}) AS BIGINT) AS log_bytes, count(*) AS records FROM events")
def wal_bytes(spark, sf_dir):
    return events(spark, sf_dir).agg(F.sum(sizes.log_bytes(_key(), _value())).alias("log_bytes"), F.count(F.lit(1)).alias("records"))


@query(f"SELECT event_id, CAST(15 + {_KLEN} + {_VLEN} AS BIGINT) AS entry_bytes FROM events")
def entry_bytes(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", sizes.entry_bytes(_key(), _value()).alias("entry_bytes"))


@query(f"SELECT event_id // {CHUNK} AS gen, min(user_id) AS min_key, max(user_id) AS max_key FROM events GROUP BY 1")
def min_key(spark, sf_dir):
    return events(spark, sf_dir).groupBy(_gen().alias("gen")).agg(F.min("user_id").alias("min_key"), F.max("user_id").alias("max_key"))


@query(f"SELECT event_id // {CHUNK} AS gen, count(*) AS mutations, count(DISTINCT user_id) AS keys, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS tombstones FROM events GROUP BY 1")
def engine_stats(spark, sf_dir):
    return events(spark, sf_dir).groupBy(_gen().alias("gen")).agg(F.count(F.lit(1)).alias("mutations"), F.countDistinct("user_id").alias("keys"), F.sum(_tombstone().cast("long")).alias("tombstones"))


@query("SELECT doc_id, CAST(strlen(repeat(text, 2)) AS BIGINT) AS key_bytes FROM documents WHERE strlen(repeat(text, 2)) > 65535")
def key_limit_guard(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.repeat("text", 2).alias("key"))
    return docs.where(~sizes.key_fits("key")).select("doc_id", sizes.byte_length("key").alias("key_bytes"))


@query("SELECT a.event_id, CASE WHEN encode(a.props) < encode(b.props) THEN -1 WHEN a.props = b.props THEN 0 ELSE 1 END AS compared FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def compare_keys(spark, sf_dir):
    a = events(spark, sf_dir).select("event_id", "props")
    b = a.select((F.col("event_id") - 1).alias("event_id"), F.col("props").alias("other"))
    return a.join(b, "event_id").select("event_id", sizes.compare_keys("props", "other").alias("compared"))


@query(f"SELECT user_id, event_type = 'error' AS deleted FROM ({_LATEST_SQL})")
def is_deleted(spark, sf_dir):
    return _latest(events(spark, sf_dir)).select("user_id", sizes.is_deleted(_tombstone()).alias("deleted"))


# ---------------------------------------------------------------- order and blocks


@query(f"SELECT {_ROW}, row_number() OVER (ORDER BY user_id) AS place FROM ({_LATEST_SQL})")
def ordered_scan(spark, sf_dir):
    """Keys in order, tombstones included. Places come from a range exchange: rank within a partition plus the rows of those before it."""
    return _placed(_latest(events(spark, sf_dir)), "user_id")


def _placed(df: DataFrame, key: str) -> DataFrame:
    """df with `place`, its rank by a unique key, without gathering the rows in one task.

    The rows are sorted into ranges and written once, each with its partition and its place there. Counts and ranks
    come from what was written, so that they agree whatever a second evaluation of the ranges would have given.
    """
    _shared(df.sparkSession)
    ordered = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # a row a partition: the window and the broadcast side are bounded by the number of partitions
    return ordered.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("place", (at + F.col("_before") + 1).cast("long")).drop("_part", "_id", "_before")


_ENTRY = 37
_BLOCK_SQL = f"SELECT (place - 1) // {4092 // _ENTRY} AS block, min(user_id) AS first_key, count(*) AS entries FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) AS place FROM ({_LATEST_SQL})) GROUP BY 1"


@query(_BLOCK_SQL)
def block_index(spark, sf_dir):
    rows = _placed(_latest(events(spark, sf_dir)), "user_id").withColumn("block", sizes.block_of("place", _ENTRY))
    return rows.groupBy("block").agg(F.min("user_id").alias("first_key"), F.count(F.lit(1)).alias("entries"))


@query(f"SELECT p.user_id, max(b.first_key) AS first_key FROM {_PROBE_SQL} JOIN ({_BLOCK_SQL}) b ON b.first_key <= p.user_id GROUP BY 1")
def floor_block(spark, sf_dir):
    """The block that may hold each probe: of the first keys the largest that is not above it, by one ordered pass of both lists."""
    index = block_index(spark, sf_dir).select("first_key")
    both = index.select(F.col("first_key").alias("at"), F.col("first_key"), F.lit(0).alias("probe")).unionAll(_probes(spark).select(F.col("user_id").alias("at"), F.lit(None).cast("long").alias("first_key"), F.lit(1).alias("probe")))
    # the index has one row for some hundred entries and the probes are a given list
    floor = F.last("first_key", ignorenulls=True).over(Window.orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("first_key", floor).where("probe = 1 and first_key is not null").select(F.col("at").alias("user_id"), "first_key")


# ---------------------------------------------------------------- log and recovery

_BAD = 613
_PREFIX_SQL = f"SELECT {_ROW} FROM events WHERE event_id < (SELECT coalesce(min(event_id), 9223372036854775807) FROM events WHERE event_id % 1000 = {_BAD})"


def _prefix(spark, sf_dir) -> DataFrame:
    return resolve.valid_prefix(events(spark, sf_dir), "event_id", F.col("event_id") % 1000 != _BAD).select("user_id", "event_id", "event_type", "value", "props")


@query(_PREFIX_SQL)
def wal_valid_prefix(spark, sf_dir):
    """Every thousandth record is taken for corrupt: all behind the first of these is gone."""
    return _prefix(spark, sf_dir)


@query(f"SELECT * FROM (SELECT * FROM ({_PREFIX_SQL}) QUALIFY {_NEWEST}) WHERE event_type <> 'error'")
def wal_replay(spark, sf_dir):
    return resolve.live_view(_prefix(spark, sf_dir), "user_id", "event_id", _tombstone())


def _mutations(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(
        F.lpad(_key(), 12, "0").cast("binary").alias("key"),
        _value().cast("binary").alias("value"),
        F.col("event_id").alias("ts_nanos"),
        _tombstone().alias("tombstone"),
        F.col("event_id").alias("seq"),
    )


_KV_SQL = f"SELECT lpad(CAST(user_id AS VARCHAR), 12, '0') AS key, props AS value FROM ({_LIVE_SQL})"


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(_KV_SQL)
def binary_log_replay(spark, sf_dir):
    """The log written in its binary layout, read back, checked and replayed."""
    path = f"{_scratch(spark, 'log')}/000001.wal"
    wire.write_log(_mutations(spark, sf_dir), path)
    return _texts(wire.replay(spark, path))


@query(f"SELECT lpad(CAST(user_id AS VARCHAR), 12, '0') AS key, CASE WHEN event_type <> 'error' THEN props END AS value FROM ({_LATEST_SQL})")
def binary_run_scan(spark, sf_dir):
    """The newest versions written as a binary run and scanned."""
    path = f"{_scratch(spark, 'run')}/000001.sst"
    wire.write_run(resolve.latest(_mutations(spark, sf_dir), "key", "seq"), path)
    return _texts(wire.read_run(spark, path))


@query("SELECT lpad(CAST(user_id AS VARCHAR), 12, '0') AS key, CASE WHEN event_type <> 'error' THEN props END AS value, event_id AS ts_nanos FROM events")
def entry_codec(spark, sf_dir):
    found = decode_entries(encode_entries(_mutations(spark, sf_dir).drop("seq")))
    return found.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "ts_nanos")


# ---------------------------------------------------------------- membership


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def bloom_semijoin(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").cast("string").alias("key"), "o_custkey")
    few = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey < 5").select(F.col("c_custkey").cast("string").alias("key"))
    return membership.semi_join(orders, few, "key").select("o_orderkey", "o_custkey")


_COUNTS = (1, 10, 1_000, 10_000, 100_000, 50_000_000)


@query(
    "SELECT CAST(n AS BIGINT) AS items, CAST(greatest(8, ceil(-n * ln(0.01) / (ln(2) * ln(2)))) AS BIGINT) AS bits, "
    "CAST(least(30, greatest(1, ceil(greatest(8, ceil(-n * ln(0.01) / (ln(2) * ln(2)))) / n * ln(2)))) AS BIGINT) AS hashes FROM (VALUES "
    + ", ".join(f"({n})" for n in _COUNTS)
    + ") AS c(n)"
)
def bloom_params(spark, sf_dir):
    return spark.createDataFrame([(n, *sizes.bloom_bits(n)) for n in _COUNTS], "items bigint, bits bigint, hashes bigint")


# ---------------------------------------------------------------- the table


def _loaded(spark, sf_dir, batches: int, **options) -> KeyedTable:
    """The events as a table, in batches of event ids."""
    table = open_table(spark, _scratch(spark, "table"), TableOptions(**{"auto_flush": False, "auto_compact": False} | options))
    rows = _mutations(spark, sf_dir)
    last = rows.agg(F.max("seq")).first()[0] or 0
    for k in range(batches):
        table.apply(rows.where((F.col("seq") * batches >= last * k + k) & (F.col("seq") * batches < (last + 1) * (k + 1))), order="seq")
    return table


@query(_KV_SQL)
def table_live(spark, sf_dir):
    """Some batches, one flushed, the others pending."""
    table = _loaded(spark, sf_dir, 1)
    table.flush()
    table.apply(_mutations(spark, sf_dir), order="seq")
    return _texts(table.live())


@query(_KV_SQL)
def full_compaction(spark, sf_dir):
    table = _loaded(spark, sf_dir, 2, memtable_bytes=1, auto_flush=True)
    table.compact(force=True)
    return _texts(table.versions())


_TABLE_PROBES = "(VALUES " + ", ".join(f"('{x:012d}')" for x in _PROBES if x > 0) + ") AS p(key)"


@query(f"SELECT p.key, value, value IS NOT NULL AS found FROM {_TABLE_PROBES} LEFT JOIN ({_KV_SQL}) USING (key)")
def table_multi_get(spark, sf_dir):
    table = _loaded(spark, sf_dir, 2, memtable_bytes=1, auto_flush=True)
    keys = spark.createDataFrame([(f"{x:012d}",) for x in _PROBES if x > 0], "key string")
    return table.multi_get(keys).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "found")


@query(f"SELECT p.key, CASE WHEN l.event_id IS NULL THEN 'absent' WHEN event_type = 'error' THEN 'deleted' ELSE 'live' END AS status FROM {_TABLE_PROBES} LEFT JOIN (SELECT *, lpad(CAST(user_id AS VARCHAR), 12, '0') AS key FROM ({_LATEST_SQL})) l USING (key)")
def table_status(spark, sf_dir):
    table = _loaded(spark, sf_dir, 2)
    keys = spark.createDataFrame([(f"{x:012d}",) for x in _PROBES if x > 0], "key string")
    return table.status(keys).select(F.col("key").cast("string").alias("key"), "status")


@query(f"SELECT key, value FROM ({_KV_SQL}) WHERE key >= '000000000005' AND key < '000000000050'")
def table_range_scan(spark, sf_dir):
    return _texts(_loaded(spark, sf_dir, 2).scan(b"000000000005", b"000000000050"))


# ---------------------------------------------------------------- streams


@query(_KV_SQL)
def stream_ingest(spark, sf_dir):
    """The events as a stream into a table, each micro-batch one commit."""
    table = open_table(spark, _scratch(spark, "table"), TableOptions(auto_flush=False))
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    mutations = source.select(F.lpad(_key(), 12, "0").cast("binary").alias("key"), _value().cast("binary").alias("value"), _tombstone().alias("tombstone"), "event_id")
    table.ingest_stream(mutations, _scratch(spark, "checkpoint"), order="event_id", available_now=True).awaitTermination()
    return _texts(table.live())


@query(_LIVE_SQL)
def stream_live_view(spark, sf_dir):
    """The live view kept by a streaming aggregation."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    rows = source.select(*_EVENTS).withColumn("tombstone", _tombstone())
    view = live.live_aggregate(rows, ["user_id"], "event_id", "tombstone").drop("tombstone")
    return live.drained(view, _scratch(spark, "view"), _scratch(spark, "checkpoint"))


@query(_LATEST_SQL)
def stream_changes(spark, sf_dir):
    """The changelog of newest rows kept by a stateful stream; the newest change of each key is its newest version."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    rows = source.select(*_EVENTS).withColumn("tombstone", _tombstone())
    path = _scratch(spark, "changes")
    writer = live.changes(rows, ["user_id"], "event_id").writeStream.outputMode("update").option("checkpointLocation", _scratch(spark, "checkpoint"))
    writer = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).trigger(availableNow=True)
    with live.state_in_rocksdb(spark):
        writer.start().awaitTermination()
    return _latest(spark.read.parquet(path).select(*_EVENTS))
