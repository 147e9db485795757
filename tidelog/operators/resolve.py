"""Last-writer-wins over mutations. All functions take and return frames and plan nothing beyond one aggregation by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _columns(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def latest(df: DataFrame, keys, order) -> DataFrame:
    """The newest row of each key: the one of the largest `order`, tombstones included.

    Plans as a partial and a final max_by, so a key with very many versions is reduced before the shuffle.
    Filters on keys pass below it, others don't. Order columns must not be null; ties fall to the largest of the other columns.
    """
    keys, order = _columns(keys), _columns(order)
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order and _sortable(df, c)]))
    return df.groupBy(*keys).agg(newest.alias("_newest")).select(*keys, *[F.col(f"_newest.`{c}`").alias(c) for c in rest]).select(*df.columns)


def _sortable(df: DataFrame, column: str) -> bool:
    return not any(x in df.schema[column].dataType.simpleString() for x in ("map<", "variant"))


def purge(df: DataFrame, tombstone: str | Column = "tombstone") -> DataFrame:
    """Without tombstones. Only right behind latest(), and only if the oldest versions are among the rows."""
    return df.where(~(F.col(tombstone) if isinstance(tombstone, str) else tombstone))


def live_view(df: DataFrame, keys, order, tombstone: str | Column = "tombstone") -> DataFrame:
    return purge(latest(df, keys, order), tombstone)


def merge(newest_first: list[DataFrame], keys="key", within: tuple[str, ...] = ()) -> DataFrame:
    """Sources merged with override: of equal keys the row of the earliest source in the list, then of the largest `within`."""
    if not newest_first:
        raise ValueError("nothing to merge")
    ranked = [df.withColumn("_source", F.lit(-i)) for i, df in enumerate(newest_first)]
    return latest(reduce(DataFrame.unionByName, ranked), keys, ("_source", *within)).drop("_source")


def shadowed(df: DataFrame, keys) -> DataFrame:
    """For each key the versions that newer ones hide."""
    return df.groupBy(*_columns(keys)).agg((F.count(F.lit(1)) - 1).alias("shadowed"))


def status(probes: DataFrame, df: DataFrame, key: str, order, tombstone: str = "tombstone", broadcast: bool = False) -> DataFrame:
    """key and status (live, deleted or absent) of each probe. Probes reach the rows before these are resolved."""
    wanted = probes.select(key).distinct()
    side = F.broadcast(wanted) if broadcast else wanted
    newest = latest(df.select(key, *[c for c in (*_columns(order), tombstone) if c != key]).join(side, key, "left_semi"), key, order)
    kind = F.when(F.col(tombstone).isNull(), "absent").when(F.col(tombstone), "deleted").otherwise("live")
    return probes.select(key).join(newest, key, "left").select(key, kind.alias("status"))


def multi_get(probes: DataFrame, df: DataFrame, key: str, order, tombstone: str = "tombstone", broadcast: bool = False) -> DataFrame:
    """All columns of the live row of each probe, and `found`. Probes reach the rows before these are resolved."""
    wanted = probes.select(key).distinct()
    side = F.broadcast(wanted) if broadcast else wanted
    hits = live_view(df.join(side, key, "left_semi"), key, order, tombstone)
    return wanted.join(hits.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def valid_prefix(df: DataFrame, order: str, valid: str | Column) -> DataFrame:
    """The rows before the first that is not valid. That row's place is one aggregate, joined back as a single row."""
    good = F.col(valid) if isinstance(valid, str) else valid
    first = df.where(~F.coalesce(good, F.lit(False))).agg(F.min(order).alias("_first_bad"))
    return df.join(F.broadcast(first), F.col("_first_bad").isNull() | (F.col(order) < F.col("_first_bad"))).drop("_first_bad")
