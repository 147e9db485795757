"""The live view as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _Newest(StatefulProcessor):
    """Keeps the order of a key's newest row, tombstones included, so that an older row of a later batch neither wins nor revives a deleted key."""

    def __init__(self, order: str, names: list[str]):
        self.order, self.names = order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, at = None, self.newest.get()[0] if self.newest.exists() else None
        for part in rows:
            top = part.loc[[part[self.order].idxmax()]]
            if at is None or int(top[self.order].iloc[0]) > at:
                best, at = top, int(top[self.order].iloc[0])
        if best is not None:
            self.newest.update((at,))
            yield best[self.names]

    def close(self) -> None:
        pass


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The setting under which queries with value state can be started."""
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, held) if held else spark.conf.unset(name)


def changes(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """In update mode, the rows that become the newest of their keys, one a key and micro-batch, tombstones included.

    `order` is a long; of equal ones the first to come stays. State is one long for each key seen. Start it under state_in_rocksdb().
    """
    return stream.groupBy(*keys).transformWithStateInPandas(_Newest(order, stream.columns), stream.schema, "Update", "None")


def live_aggregate(stream: DataFrame, keys: list[str], order: str, tombstone: str) -> DataFrame:
    """In complete mode, the live rows so far, by `order` across batches. State keeps deleted keys as well."""
    rest = [c for c in stream.columns if c not in keys]
    newest = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_newest"))
    return newest.where(~F.col(f"_newest.{tombstone}")).select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in rest])


def drained(view: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The view after all that its sources hold now. Each micro-batch is written by the executors; the last one counts."""
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number:08d}")
        last[:] = [number]

    view.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = view.sparkSession
    return spark.read.parquet(f"{path}/batch-{last[0]:08d}") if last else spark.createDataFrame([], view.schema)
