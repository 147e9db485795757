"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it new to df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a temporary one does in local mode, and nothing does on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there: lineage ends, lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Ids that are broadcast at most; with more of them, rows are joined by shuffle.
MOST_IDS = 200_000


def without(documents: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The documents whose key is not among the ids (one column), with all their columns. Null keys go if null is among the ids.

    The ids are written and counted first: up to MOST_IDS they are broadcast, so that texts are not shuffled.
    """
    (name,) = free(documents, "gone_id")
    gone = cut(ids.toDF(name).distinct())
    side = F.broadcast(gone) if gone.count() <= MOST_IDS else gone
    return documents.join(side, F.col(f"`{key}`").eqNullSafe(F.col(name)), "left_anti")


#: Bytes of the longest text that a classifier learns from; longer ones are scored like all others.
LEARNED_BYTES = 65_536


def labelled_sample(labels: DataFrame, documents: DataFrame, label: str, per_class: int, most: int) -> list:
    """Driver rows (text, label) to fit a classifier on: per_class rows of each label, or most / labels of each if that is less (one at least).

    labels: doc_id and `label`. Of each label the rows of the smallest key hashes are taken, so the same ones whatever the partitions; each task
    passes on per_class rows a label at most. Only ids are gathered before the texts of the chosen ones are read, and texts over
    LEARNED_BYTES are left out, so that the driver holds most * LEARNED_BYTES at most.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label).distinct()
    own = Window.partitionBy(label).orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(label)), "doc_id")
    ranked = cut(rows.withColumn("own_rank", F.row_number().over(own)).where(F.col("own_rank") <= per_class))
    kinds = ranked.where("own_rank = 1").count()
    if not kinds:
        return []
    chosen = ranked.where(F.col("own_rank") <= max(1, most // kinds)).select("doc_id", label)
    texts = documents.where(F.col("text").isNotNull() & (F.octet_length("text") <= LEARNED_BYTES)).select("doc_id", "text")
    side = F.broadcast(chosen) if chosen.count() <= MOST_IDS else chosen
    found = texts.join(side, "doc_id").select("doc_id", "text", label)
    return sorted(found.collect(), key=lambda r: (str(r[0]), r[1], str(r[2])))
