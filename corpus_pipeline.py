"""A corpus pipeline of five stages, each one operator of tidelog.llm.

Each function takes (spark, docs, sf_dir) and returns a frame; run() writes each stage's result below the shared folder
and reads it again for the next one. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import op1_quality, op3_decontamination, op4_alike, op8_sentencepiece, op10_substrings
from tidelog.llm.common import fold, scratch, table

# Near-duplicates are texts whose sets of five-word shingles have an exact cosine similarity of 0.8 (4 / 5) or more.
NEAR = {"shingle": 5, "alike": (4, 5)}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(fold("doc_id", 3) != 1)
    return op1_quality.keep_good(docs, op1_quality.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_alike.keep_one(docs, **NEAR)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_substrings.deduplicated(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_decontamination.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_sentencepiece.segmented(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
