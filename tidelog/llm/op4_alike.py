"""Near-duplicates by an exact similarity of shingle sets, with SimHash anchors as the search.

SimHash estimates the angle between vectors, so the similarity is its cosine: of the sets A and B of word shingles,
|A and B| / sqrt(|A| |B|). Words are lower-cased in A-Z and consist of ASCII letters, digits and all non-ASCII characters; a text of fewer
words than a shingle has one shingle, of all of them.

Search: WORDS fingerprints of 64 bits each (majorities of the shingles' hashes, mixed anew for each) are replicated to anchors: each of
four blocks of 15 bits a fingerprint is covered by the perfect [15,11] code, and a block is compared within 1 beyond the covering radius. Candidates
differ in BITS of the 256 bits at most. At a cosine of 0.8, the least that links, 52 bits differ on average with a deviation of 6.5; a
random pair meets the bound once in 3e10. Candidates form coarse components, and within each of these the sets themselves
decide, so nothing links that is not alike. Of pairs just at the bound the search finds 99.5 % or more (tests/llm measure it); a larger cosine is missed still less.

Texts that share the smallest hash of their sets, under one of two mixings, are held against one of them first, so that a large group of near copies is
a few nodes' worth of links when it comes to the anchors, and not one for each anchor at which its members meet.

Scale: fingerprints come from one pass; only sets of texts with a candidate are computed again and sent (a map of 2^26 bits of their ids
sorts the others out beforehand). Coarse components over `most_hashes` are split into pairs of parts; each group yields a forest of links. The
comparisons at anchors are quadratic in the distinct texts, n * n / 17 of one 64-bit word each, spread evenly over 32,768 anchors.

Defined cases: null text counts as empty; texts without words are copies only of texts that are equal but for white space at the ends; rows that repeat a doc_id
are one document: they stay or go together; rows without a doc_id take no part and stay; repeated rows change nothing; texts of any length
count whole; an empty table gives an empty result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_IDS, cut, without
from .components import components
from .op4_simhash import MOST, apart, join_up, links, majority, perfect_cover

WORDS, BITS, LEAD_BITS = 4, 75, 26
MOST_HASHES = 1_000_000  # of the sets that meet in one task, in each part of a component
ROW_HASHES = 256  # what a set counts for besides its hashes
_SLOTS, _SALTS, _BLOCK = 1 << 26, 16, 200_000
_NAMES = [f"f{k}" for k in range(WORDS)]
_LEAST = ["m0", "m1"]
_TABLE = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Hashes(dict):
    """The hash of every word, kept for the words of some texts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], shingle: int, known: dict | None = None) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; none if it has no words."""
    known = _Hashes() if known is None else known
    words = [x.encode("utf-8", "surrogatepass").translate(_TABLE).split() if x else [] for x in texts]
    sizes = np.array([len(x) for x in words], dtype=np.int64)
    flat = np.fromiter((known[w] for x in words for w in x), dtype=np.uint64, count=int(sizes.sum()))
    grams = flat.copy()
    for j in range(1, shingle):
        grams = mixed(grams[: len(flat) - j] + np.uint64(0x9E3779B97F4A7C15)) + flat[j:]
    out, at = [], 0
    for n in sizes.tolist():
        if n >= shingle:
            out.append(np.unique(grams[at : at + n - shingle + 1]))
        else:
            own = flat[at : at + min(n, 1)]
            for j in range(1, n):
                own = mixed(own + np.uint64(0x9E3779B97F4A7C15)) + flat[at + j]
            out.append(own)
        at += n
    return out


def prints_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """WORDS fingerprints of each set, by hashes mixed anew for each, and the smallest hashes of the first two of these; zeros for an empty set."""
    out, least = np.zeros((len(sets), WORDS), dtype=np.uint64), np.zeros((len(sets), len(_LEAST)), dtype=np.uint64)
    rows = [i for i, x in enumerate(sets) if len(x)]
    for at in range(0, len(rows), 200):
        some = rows[at : at + 200]
        sizes = np.array([len(sets[i]) for i in some])
        starts, hashes = np.cumsum(sizes) - sizes, np.concatenate([sets[i] for i in some])
        for k in range(WORDS):
            hashes = mixed(hashes + np.uint64(0xA0761D6478BD642F))
            out[some, k] = majority(hashes, starts)
            if k < len(_LEAST):
                least[some, k] = np.minimum.reduceat(hashes, starts)
    return out, least


def node_of(text: str | None, shingles: np.ndarray) -> int:
    """Equal sets are one node; without words the text itself is."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), 1) if len(shingles) else xxhash.xxh64_intdigest((text or "").strip().encode("utf-8", "surrogatepass"), 2)


def linked(sets: list[np.ndarray], prints: np.ndarray, alike: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root), one a row at most, that join the sets whose cosine is alike[0] / alike[1] or more.

    A pair that is joined by others already is not compared, nor one whose fingerprints are further apart than BITS.
    """
    n = len(sets)
    label, size = np.arange(n), np.array([len(x) for x in sets], dtype=np.int64)
    bound = lambda i, j: alike[0] ** 2 * size[i] * size[j]
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[label[i + 1 :] != label[i]]
        j = j[alike[1] ** 2 * np.minimum(size[i], size[j]) ** 2 >= bound(i, j)]
        j = j[apart(prints, np.full(len(j), i), j) <= BITS]
        if not len(j) or not size[i]:
            continue
        for part in np.split(j, np.flatnonzero(np.diff(np.cumsum(size[j]) // _BLOCK)) + 1):
            part = part[label[part] != label[i]]
            if not len(part):
                continue
            every = np.concatenate([sets[x] for x in part])
            spot = np.minimum(np.searchsorted(sets[i], every), size[i] - 1)
            common = np.add.reduceat((sets[i][spot] == every).astype(np.int64), np.cumsum(size[part]) - size[part])
            part = part[alike[1] ** 2 * common**2 >= bound(i, part)]
            join_up(label, np.full(len(part), i), part)
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def sketched(texts: DataFrame, shingle: int) -> DataFrame:
    """doc_id, node, size (distinct shingles), fingerprints and smallest hashes of every row of doc_id and text."""
    known = _Hashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                rows = batch.column(1).to_pylist()
                sets = shingle_sets(rows, shingle, known)
                node = np.array([node_of(t, x) for t, x in zip(rows, sets, strict=True)], dtype=np.uint64).view(np.int64)
                found = np.concatenate(prints_of(sets), axis=1).view(np.int64)
                columns = [node, np.array([len(x) for x in sets]), *map(np.ascontiguousarray, found.T)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", "node", "size", *_NAMES, *_LEAST])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, node bigint, size bigint, " + ", ".join(f"{x} bigint" for x in [*_NAMES, *_LEAST]))


def _mark(side: str) -> Column:
    return F.xxhash64(*[f"{side}{k}" for k in range(WORDS)])


def led(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of marks of fingerprints that differ in BITS bits at most and share one of their smallest hashes; b is the first that does.

    One pair a fingerprint and hash. Leaders are repeated for each of _SALTS parts, so that a hot hash is not one task.
    """
    shared = F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.col(x).alias("least")) for k, x in enumerate(_LEAST)])).alias("at")
    rows = prints.select(*_NAMES, "mark", shared).select(*_NAMES, "mark", "at.*")
    first = F.min(F.struct(*[F.col(f"f{k}").alias(f"l{k}") for k in range(WORDS)])).alias("first")
    leaders = rows.groupBy("which", "least").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("which", "least", "first.*", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    bits = sum((F.bit_count(F.col(f"f{k}").bitwiseXOR(F.col(f"l{k}"))) for k in range(WORDS)), F.lit(0))
    met = rows.withColumn("salt", F.pmod("mark", F.lit(_SALTS)).cast("int")).join(leaders, ["which", "least", "salt"]).where(bits <= BITS)
    return met.select(F.col("mark").alias("a"), _mark("l").alias("b")).where("a <> b")


def candidates(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """node, least_id, size and root of every node that shares its coarse component with others."""
    prints = cut(nodes.groupBy(*_NAMES).agg(*[F.min(x).alias(x) for x in _LEAST]).withColumn("mark", _mark("f")))
    near = cut(led(prints))
    known = components(near)
    labelled = prints.join(known, F.col("mark") == F.col("a"), "left").select(*_NAMES, F.coalesce("b", "mark").alias("known"))
    found = links(labelled, WORDS, perfect_cover(WORDS), 1, BITS, most, LEAD_BITS)
    coarse = components(found.select(_mark("a").alias("a"), _mark("b").alias("b")).unionAll(near))
    marked = nodes.withColumn("mark", _mark("f"))
    twins = marked.groupBy("mark").count().where("count > 1").select(F.col("mark").alias("a"), F.col("mark").alias("b"))
    rooted = coarse.unionAll(coarse.select("b", F.col("b").alias("b2"))).unionAll(twins).groupBy("a").agg(F.min("b").alias("root"))
    return cut(marked.join(rooted, F.col("mark") == F.col("a")).select("node", "least_id", "size", "root"))


def confirmed(texts: DataFrame, chosen: DataFrame, shingle: int, alike: tuple[int, int], most_hashes: int = MOST_HASHES) -> DataFrame:
    """Pairs (a, b) of nodes that are alike, enough of them to join all that such pairs connect. chosen: as candidates() gives them."""
    spark = texts.sparkSession
    weights = chosen.groupBy("root").agg(F.sum(F.col("size") + ROW_HASHES).alias("weight")).where(F.col("weight") > most_hashes)
    heavy = cut(weights.select("root", F.ceil(F.col("weight") / most_hashes).alias("parts")))
    side = F.broadcast(heavy) if heavy.count() <= MOST_IDS else heavy
    wanted = chosen.join(side, "root", "left").select("node", "least_id", "root", F.coalesce("parts", F.lit(1)).cast("bigint").alias("parts"))
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(_SLOTS))
    maps = chosen.groupBy(F.shiftright(slot("least_id"), 15).alias("k")).agg(F.bitmap_construct_agg(slot("least_id") % (1 << 15)).alias("bits"))
    held = np.zeros((1 << 11, 1 << 12), dtype=np.uint8)
    for r in maps.collect():  # 2,048 pieces of 4 KiB at most
        held[r["k"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    held = held.reshape(-1)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, told = _Hashes(), set()
        for whole in batches:
            x = whole.column("slot").to_numpy()
            some = whole.filter(pa.array((held[x >> 3] >> (x & 7).astype(np.uint8) & 1).astype(bool)))
            for at in range(0, len(some), 500):
                batch = some.slice(at, 500)
                sets = shingle_sets(batch.column("text").to_pylist(), shingle, known)
                ids, nodes = batch.column("doc_id").to_pylist(), [node_of(None, s) for s in sets]
                new = [k for k in range(len(sets)) if len(sets[k]) and (ids[k], nodes[k]) not in told]  # repeated rows once a task
                told.update((ids[k], nodes[k]) for k in new)
                prints = prints_of([sets[k] for k in new])[0].view(np.int64)
                columns = [np.array([nodes[k] for k in new], dtype=np.uint64).view(np.int64), *(np.ascontiguousarray(prints[:, w]) for w in range(WORDS))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(new, pa.int64())), *map(pa.array, columns), pa.array([sets[k].tobytes() for k in new], pa.binary())], names=["doc_id", "own", *_NAMES, "shingles"])

    words = ", ".join(f"{x} bigint" for x in _NAMES)
    found = texts.select("doc_id", "text", slot("doc_id").alias("slot")).mapInArrow(sets_of, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, own bigint, {words}, shingles binary")
    sent = found.join(wanted, (F.col("doc_id") == F.col("least_id")) & (F.col("own") == F.col("node"))).select("root", "parts", "node", *_NAMES, "shingles")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # each set goes to every pair of parts of its component that has its own part
            node, parts = batch.column("node").to_numpy(), batch.column("parts").to_numpy()
            mine = (node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
            row = np.repeat(np.arange(len(node)), parts)
            other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            pair = np.minimum(mine[row], other) * parts[row] + np.maximum(mine[row], other)
            for at in range(0, len(row), 100):
                some = batch.take(pa.array(row[at : at + 100]))
                yield pa.RecordBatch.from_arrays([some.column("root"), pa.array(pair[at : at + 100]), *(some.column(x) for x in ("node", *_NAMES, "shingles"))], names=["root", "pair", "node", *_NAMES, "shingles"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _groups(batches, "root", "pair"):
            node = run.column("node").to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in run.column("shingles").to_pylist()]
            prints = np.stack([run.column(x).to_numpy() for x in _NAMES], axis=1).view(np.uint64)
            rows, other = linked(sets, prints, alike)
            yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(node[other])], names=["a", "b"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = sent.mapInArrow(deal, f"root bigint, pair bigint, node bigint, {words}, shingles binary")
    return dealt.repartition(parts, "root", "pair").sortWithinPartitions("root", "pair").mapInArrow(meet, "a bigint, b bigint").distinct()


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The sorted batches as one table for each group of equal keys."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        first = [0, *(np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in columns])) + 1).tolist(), len(batch)]
        for a, b in zip(first, first[1:], strict=False):
            if rest and any(rest[0].column(k)[0] != batch.column(k)[a] for k in keys):
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest)


def alike_documents(documents: DataFrame, shingle: int = 5, alike: tuple[int, int] = (4, 5), most: int = MOST, most_hashes: int = MOST_HASHES) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over links) of every document that has a doc_id.

    Two texts link if the cosine of their sets of shingles is alike[0] / alike[1] or more.
    """
    texts = documents.where("doc_id is not null").select("doc_id", "text")
    named = cut(sketched(texts, shingle))
    nodes = cut(named.groupBy("node").agg(F.min("doc_id").alias("least_id"), *[F.min(x).alias(x) for x in ("size", *_NAMES, *_LEAST)]))
    pairs = confirmed(texts, candidates(nodes.where("size > 0"), most), shingle, alike, most_hashes)
    # A component's nodes are (least_id, node), so that its smallest one names it.
    vertices = nodes.select("node", "least_id", F.struct("least_id", "node").alias("vertex"))
    side = lambda x: vertices.select(F.col("node").alias(x), F.col("vertex").alias(f"{x}_vertex"))
    roots = components(pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("a_vertex").alias("a"), F.col("b_vertex").alias("b")))
    least = vertices.join(roots, vertices["vertex"] == roots["a"], "left").select("node", F.coalesce("b", "vertex")["least_id"].alias("component_id"))
    return named.select("doc_id", "node").join(least, "node").select("doc_id", "component_id")


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One document of each group of alike_documents(), the one of the smallest doc_id, with all its columns."""
    found = alike_documents(documents, **options)
    return without(documents, "doc_id", found.where("doc_id > component_id").select("doc_id"))
