"""Approximate nearest neighbours by an inverted multi-index, under the inner product.

The two halves of the vectors are quantised separately, with k centroids each; a cell is a pair of centroids. The number of cells grows
as the square root of the entries (CENTRES centroids a half for CENTRES_AT entries), so that cells and entries a cell grow alike. A query
scores the centroids of either half and goes through the pairs in order of their sum with a heap, until the
cells gone through hold a set share of the entries. Those entries are reranked by the exact inner product in double
precision.

Fitting: centroids and share come from a sample of at most SAMPLE vectors, or 64 a centroid (those of the smallest key hashes); the share
is the smallest that gives a recall of RECALL on the sample, by brute force over it. Vectors without structure
need a large share, clustered ones a small one. All vectors are indexed.

Scale: equal vectors are one entry, with their `top` + 1 smallest ids, and equal queries are one search; nothing is
lost, as equal vectors tie and the smaller ids go first. Cells are dealt out in blocks of at most BLOCK entries
and BLOCK queries, so neither a hot cell nor a popular one meets in one task. A block passes on the best `top` + 1
a query, which are pre-ranked again before each shuffle.

Defined cases: vectors that are null, empty, zero, of another than the commonest length, or hold null or non-finite
components take no part, nor do null ids; repeated rows count once; fewer candidates than `top` give all; ties
go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

NAME = "op5_neighbours"
TOP, SAMPLE, RECALL, BLOCK, CENTRES, CENTRES_AT = 20, 10_000, 0.96, 2_048, 16, 50_000


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, each once."""
    finite = F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    good = rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    sizes = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.where(F.size("embedding") == (sizes[0]["n"] if sizes else 0)).distinct()


def _kmeans(points: np.ndarray, k: int, turns: int = 12, seed: int = 3) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = points[random.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(turns):
        own = (points @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


class MultiIndex:
    """Centroids of either half, and the share of the entries that a query goes through."""

    def __init__(self, sample: np.ndarray, k: int, top: int = TOP, recall: float = RECALL):
        self.half = sample.shape[1] // 2
        self.first, self.second = (_kmeans(x.astype(np.float64), k) for x in (sample[:, : self.half], sample[:, self.half :]))
        self.counts = np.zeros(len(self.first) * len(self.second), dtype=np.int64)
        self.share = self._calibrated(sample.astype(np.float64), top, recall)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = ((x @ c.T * 2 - (c**2).sum(1)).argmax(1) for x, c in ((vectors[:, : self.half], self.first), (vectors[:, self.half :], self.second)))
        return a * len(self.second) + b

    def order(self, query: np.ndarray) -> Iterator[int]:
        """Cells by falling sum of the two halves' inner products with their centroids."""
        a, b = self.first @ query[: self.half], self.second @ query[self.half :]
        by_a, by_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[by_a], b[by_b]
        heap, row = [(-(a[0] + b[0]), 0, 0)], np.zeros(len(a), dtype=int)
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(by_a[i]) * len(by_b) + int(by_b[j])
            row[i] = j + 1
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))

    def visit(self, query: np.ndarray, least: float) -> list[int]:
        """Cells that hold entries, in order, until they hold `least` of them."""
        out, held = [], 0
        for cell in self.order(query):
            if self.counts[cell]:
                out.append(cell)
                held += self.counts[cell]
                if held >= least:
                    break
        return out

    def _calibrated(self, sample: np.ndarray, top: int, recall: float) -> float:
        own = self.cells(sample)
        counts = np.bincount(own, minlength=len(self.counts))
        queries = range(0, len(sample), max(1, len(sample) // 200))
        needs = []
        for q in queries:
            scores = sample @ sample[q]
            scores[q] = -np.inf
            best = np.argpartition(-scores, min(top, len(scores) - 1))[:top]
            order = np.fromiter(self.order(sample[q]), dtype=int)
            place = np.empty(len(order), dtype=int)
            place[order] = np.arange(len(order))
            needs.extend(np.cumsum(counts[order])[place[own[best]]] / len(sample))
        return float(min(1.0, np.quantile(needs, recall)))


def neighbours(rows: DataFrame, queries: DataFrame, top: int = TOP, sample: int = SAMPLE, recall: float = RECALL, k: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest rows. rows, queries: as usable() gives them. k: centroids a half, by default as many as the entries call for."""
    spark = rows.sparkSession
    ranked = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= top + 1)
    entries = cut(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "embedding", "ids"))
    total = entries.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not total:
        return spark.createDataFrame([], schema)
    k = k or max(2, round(CENTRES * (total / CENTRES_AT) ** 0.25))
    picked = entries.select("entry", "embedding").orderBy(F.xxhash64("entry"), "entry").limit(max(sample, 64 * k)).collect()
    points = np.array([r["embedding"] for r in picked], dtype=np.float64)
    index = MultiIndex(points, k, top, recall)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("embedding"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.cells(vectors), pa.int32())], names=[*batch.schema.names, "cell"])

    kind = rows.schema["embedding"].dataType.simpleString()
    with_cells = entries.mapInArrow(placed, f"entry bigint, embedding {kind}, ids array<bigint>, cell int")
    for r in with_cells.groupBy("cell").count().collect():  # a row per cell, k * k at most
        index.counts[r["cell"]] = r["count"]
    classes = queries.groupBy("embedding").agg(F.min("vec_id").alias("query"))
    least = max(index.share * total, 4 * (top + 1))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                found = [index.visit(v, least) for v in _matrix(batch.column("embedding"))]
                again = np.repeat(np.arange(len(batch)), [len(x) for x in found])
                cells = pa.array(np.concatenate([np.array(x, dtype=np.int32) for x in found]) if found else np.zeros(0, np.int32), pa.int32())
                picks = batch.take(pa.array(again))
                yield pa.RecordBatch.from_arrays([picks.column("query"), picks.column("embedding"), cells], names=["query", "embedding", "cell"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)  # few rows, but each goes through a heap
    planned = classes.select("query", "embedding").repartition(parts, "query").mapInArrow(visits, f"query bigint, embedding {kind}, cell int")
    crowd = {r["cell"]: r["count"] for r in planned.groupBy("cell").count().collect()}
    blocks_of = lambda counts: F.create_map(*[F.lit(int(x)) for c, n in counts.items() for x in (c, -(-n // BLOCK))])[F.col("cell")] if counts else F.lit(1)
    parts_e = F.coalesce(blocks_of({c: n for c, n in enumerate(index.counts) if n > BLOCK}), F.lit(1))
    parts_q = F.coalesce(blocks_of({c: n for c, n in crowd.items() if n > BLOCK}), F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt_e = with_cells.select("entry", "embedding", "cell", F.pmod(F.xxhash64("entry"), parts_e).cast("int").alias("eb"), every(parts_q).alias("qb"))
    dealt_q = planned.select("query", "embedding", "cell", F.pmod(F.xxhash64("query"), parts_q).cast("int").alias("qb"), every(parts_e).alias("eb"))
    key = ["cell", "eb", "qb"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "entry": [], "score": []})
        asked, held = (np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in (left, right))
        right_ids = right["entry"].to_numpy()
        scores = asked @ held.T
        take = min(top + 1, len(held))
        # Bits of the scores depend on the product's blocking: those within a hair of the last are kept, then scored alike.
        edge = -np.partition(-scores, take - 1, axis=1)[:, take - 1]
        i, j = np.nonzero(scores >= (edge - 1e-9 * np.maximum(1, np.abs(edge)))[:, None])
        exact = np.einsum("ij,ij->i", asked[i], held[j])
        by = np.lexsort((right_ids[j], -exact, i))
        i, j, exact = i[by], j[by], exact[by]
        starts = np.searchsorted(i, np.arange(len(asked)))
        keep = np.arange(len(i)) - starts[i] < take
        return pd.DataFrame({"query": left["query"].to_numpy()[i[keep]], "entry": right_ids[j[keep]], "score": exact[keep]})

    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    found = dealt_q.groupBy(*key).cogroup(dealt_e.groupBy(*key)).applyInPandas(search, "query bigint, entry bigint, score double")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).drop("n")
    wide = found.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    wide = wide.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).drop("n")
    asked = queries.join(classes.withColumnRenamed("embedding", "_e"), F.col("embedding") == F.col("_e")).select(F.col("vec_id").alias("query_id"), "query")
    mine = asked.join(wide, "query").where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(usable(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))
    return neighbours(rows, rows.where("vec_id % 20 = 0"))


ORACLE_SQL = None
