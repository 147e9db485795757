"""Connected components of a graph that may be larger than any machine, by alternating star contraction.

Large-star links every larger neighbour of a node to the smallest of its neighbourhood, small-star every smaller
one; both keep the components, and what remains in the end is one star around each component's smallest node.
The rounds grow with the logarithm of the longest path. Minima are pre-aggregated before the shuffle and joined
back, so a node with very many links is never gathered in one place, and each round is cut in the shared folder.

A graph of FEW edges at most, counted first, is joined by one task instead, with the same result: rounds cost some jobs each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

FEW = 200_000


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _order(x) -> tuple:
    """Sorts as the node does in Spark: nulls first, the fields of a struct one after another."""
    return () if x is None else tuple(map(_order, x.values())) if isinstance(x, dict) else (x,)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of a whole graph of few edges."""
    node, up = {}, {}  # by sort key: the node itself, and a smaller one of its component

    def root(k: tuple) -> tuple:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    kinds = None
    for batch in batches:
        kinds = batch.schema
        for a, b in zip(*(batch.column(x).to_pylist() for x in ("a", "b")), strict=True):
            ends = []
            for x in (a, b):
                k = _order(x)
                node.setdefault(k, x)
                ends.append(root(up.setdefault(k, k) and k))
            up[max(ends)] = min(ends)
    stars = [(k, r) for k in up if (r := root(k)) != k]
    if stars:
        yield pa.RecordBatch.from_arrays([pa.array([node[s[i]] for s in stars], kinds.field(x).type) for i, x in enumerate(("a", "b"))], names=["a", "b"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """Rows (a, b), b the smallest node of a's component, for every node a of `edges` but the smallest ones themselves.

    edges: columns a and b of one orderable type, any direction, repeats and loops allowed.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _signature(now)
    if mark[0] <= few:
        return cut(now.coalesce(1).mapInArrow(_joined, now.schema))
    while mark[0]:
        now = cut(_small_star(_large_star(now)))
        was, mark = mark, _signature(now)
        if was == mark:
            break
    return now
