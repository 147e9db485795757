"""SimHash near-duplicates by anchor-point covering.

A fingerprint sums up the XXH64 hashes (seed 42) of a text's word shingles: bit i is 1 if more than half of them
have it. Words are runs of non-white-space, lower-cased in A-Z; shingles are space-joined; a text of fewer words
is one shingle, one of none has the fingerprint zero.

Search: the fingerprint's bits are cut into blocks, and the anchors of a block are the words of a code that
covers it with radius 1: a [15,11] Hamming code on its first 15 bits, the rest unconstrained. If two
fingerprints differ in at most r bits, they differ in at most t = r // blocks bits in some block. There the
one lies within 1 of its home anchor, and the other within 1 + t of the same anchor. So each distinct
fingerprint is replicated to all anchors within 1 + t of it, in each block, and the home ones are compared with all
others of their anchor. Nothing within r bits is missed.

Scale: equal fingerprints are collapsed first. Rows grow in proportion to the distinct fingerprints. Anchors that
hold over `most` rows are split into parts, and each pair of parts is a group of its own. A group yields a
forest of links, at most one a row, never all pairs. Components come from distributed contraction.

Defined cases: null text counts as empty; repeated rows are all returned; a null doc_id is ignored as a component's
smallest unless the component has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, without
from .components import components

NAME = "op4_simhash"
MOST = 20_000
_CHECKS = 15  # bits of a block under the Hamming code


# ---------------------------------------------------------------- fingerprints


def _adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of three words the sum's bits and the carries, at each bit."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of hashes that begins at one of `starts`, the bits that over half of it have.

    Fifteen hashes at a time are added up as words, to four words of bits of the sums; only these are spread out to counters.
    """
    sizes = np.diff(np.append(starts, len(hashes)))
    groups = -(-sizes // 15)
    first = np.cumsum(groups) - groups
    rows = np.zeros((int(groups.sum()) * 15,), dtype=np.uint64)
    rows[np.arange(len(hashes)) + np.repeat(first * 15 - starts, sizes)] = hashes
    column = np.ascontiguousarray(rows.reshape(-1, 15).T)
    planes, left = [], list(column)
    while len(left) > 1:  # 15 words of weight 1, 7 of weight 2, 3 of weight 4, 1 of weight 8
        total, carried = left[0], []
        for k in range(1, len(left), 2):
            total, carry = _adder(total, left[k], left[k + 1])
            carried.append(carry)
        planes.append(total)
        left = carried
    planes += left
    counts = sum(np.unpackbits(x.astype(">u8").view(np.uint8)).reshape(-1, 64) << np.uint8(k) for k, x in enumerate(planes))
    ones = np.add.reduceat(counts, first, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > sizes[:, None], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(texts: list[str | None], shingle: int, seeds: tuple[int, ...]) -> np.ndarray:
    """One row per text, one unsigned 64-bit column per seed."""
    out = np.zeros((len(texts), len(seeds)), dtype=np.uint64)
    rows: list[int] = []
    starts: list[int] = []
    grams: list[bytes] = []

    def settle() -> None:
        if rows:
            for k, seed in enumerate(seeds):
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=len(grams))
                out[rows, k] = majority(hashes, np.array(starts))
            rows.clear(), starts.clear(), grams.clear()

    for row, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            continue
        rows.append(row)
        starts.append(len(grams))
        if len(words) <= shingle:
            grams.append(b" ".join(words))
        else:
            joined = [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
            grams.extend(joined)
        if len(grams) > 200_000:
            settle()
    settle()
    return out


def fingerprinted(documents: DataFrame, shingle: int, seeds: tuple[int, ...]) -> DataFrame:
    """doc_id and the columns f0, f1, ... (one a seed, signed) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints(batch.column(1).to_pylist(), shingle, seeds).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(prints[:, k]) for k in range(len(seeds)))], names=["doc_id", *(f"f{k}" for k in range(len(seeds)))])

    key = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, " + ", ".join(f"f{k} bigint" for k in range(len(seeds))))


# ---------------------------------------------------------------- anchors


class Block(NamedTuple):
    """A run of bits of one of the fingerprints."""

    word: int
    first: int
    bits: int


def whole_cover(blocks: int) -> tuple[Block, ...]:
    """The first fingerprint cut into blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return tuple(Block(0, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))


def perfect_cover(words: int) -> tuple[Block, ...]:
    """Four blocks of 15 bits of each fingerprint, so that the anchors are the words of the perfect code alone."""
    return tuple(Block(w, 16 * k, _CHECKS) for w in range(words) for k in range(4))


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of the first 15 bits under the Hamming code whose check matrix has the columns 1 to 15."""
    out = np.zeros(x.shape, dtype=np.uint8)
    for i in range(_CHECKS):
        out ^= ((x >> np.uint64(i)) & np.uint64(1)).astype(np.uint8) * np.uint8(i + 1)
    return out


@lru_cache
def _patterns(bits: int, radius: int) -> list[np.ndarray]:
    """For each syndrome, the flips of at most `radius` bits that lead to an anchor, the home anchor's first."""
    flips = [sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(bits), n)]
    flips = np.array(flips, dtype=np.uint64)
    marks = _syndrome(flips)
    return [flips[marks == s] for s in range(16)]


def anchors(prints: np.ndarray, cover: tuple[Block, ...], within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor key, is it the row's home anchor) of every replica of the fingerprints, a column a word. Keys are below 2^27."""
    if min(x.bits for x in cover) < _CHECKS or max(x.bits for x in cover) > 22 or len(cover) > 32:
        raise ValueError("blocks have 15 to 22 bits, and there are 32 at most")
    parts = []
    for k, block in enumerate(cover):
        value = (prints[:, block.word] >> np.uint64(block.first)) & np.uint64((1 << block.bits) - 1)
        marks = _syndrome(value)
        for s, flips in enumerate(_patterns(block.bits, 1 + within)):
            rows = np.flatnonzero(marks == s)
            if len(rows):
                keys = (value[rows, None] ^ flips[None, :]).astype(np.int64) << 5 | k
                home = np.zeros(keys.shape, dtype=bool)
                home[:, 0] = True
                parts.append((np.repeat(rows, len(flips)), keys.ravel(), home.ravel()))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


# ---------------------------------------------------------------- comparison


def apart(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which rows i and j differ, over all seeds."""
    return sum(np.bitwise_count(prints[i, k] ^ prints[j, k]).astype(np.int16) for k in range(prints.shape[1]))


def here(prints: np.ndarray, i: np.ndarray, j: np.ndarray, block: np.ndarray, cover: tuple[Block, ...], within: int) -> np.ndarray:
    """Is this anchor the one at which the pair of home row i and row j is told, of all at which it meets?

    That is the smaller one's home anchor in the first block where both are within reach. Pairs within reach in no
    block meet by chance, and are told wherever they do.
    """
    first = np.full(len(i), -1)
    for k in reversed(range(len(cover))):
        differ = (prints[i, cover[k].word] ^ prints[j, cover[k].word]) >> np.uint64(cover[k].first)
        first[np.bitwise_count(differ & np.uint64((1 << cover[k].bits) - 1)) <= within] = k
    less = np.zeros(len(i), dtype=bool)
    for k in reversed(range(prints.shape[1])):
        less = np.where(prints[i, k] == prints[j, k], less, prints[i, k] < prints[j, k])
    return (first < 0) | ((first == block) & less)


def join_up(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives the rows that the pairs (i, j) connect the smallest of their labels; a label is a row that has itself as label."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            deeper = label[label]
            if np.array_equal(deeper, label):
                break
            label[:] = deeper
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]


def forest(prints: np.ndarray, home: np.ndarray, most_bits: int, told: Callable | None = None, lead: np.ndarray | None = None, lead_bits: int = 64, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root) that join the rows which home rows reach, one a row at most. prints: a column a seed.

    told: which of the pairs (i, j), i a home row, count. lead: one word of each row, in which pairs differ in lead_bits at most.
    known: rows of equal value are joined already, and one link speaks for all of them.
    """
    n = len(prints)
    own = np.arange(n)
    if known is not None:
        _, first, kind = np.unique(known, return_index=True, return_inverse=True)
        own = first[kind]
    label = own.copy()
    homes = np.flatnonzero(home)
    lead = np.ascontiguousarray(prints[:, 0]) if lead is None else lead
    step = max(1, 250_000 // max(1, n))
    for at in range(0, len(homes), step):
        some = homes[at : at + step]
        row, j = np.nonzero(np.bitwise_count(lead[some, None] ^ lead[None, :]) <= min(most_bits, lead_bits))
        i = some[row]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        close = apart(prints, i, j) <= most_bits
        i, j = i[close], j[close]
        if told:
            mine = told(i, j)
            i, j = i[mine], j[mine]
        join_up(label, i, j)
    rows = np.flatnonzero((label != np.arange(n)) & (own == np.arange(n)))
    return rows, label[rows]


def compare(groups: np.ndarray, prints: np.ndarray, home: np.ndarray, most_bits: int, told: Callable, lead: np.ndarray, lead_bits: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal group, at least one of them at home there; groups are sorted. told, lead, known: as in forest()."""
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(groups)))
    large = size > 256
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, n in zip(first[large], size[large], strict=True):
        rows, roots = forest(prints[a : a + n], home[a : a + n], most_bits, lambda i, j, a=a: told(i + a, j + a), lead[a : a + n], lead_bits, known[a : a + n])
        out.append((rows + a, roots + a))
    # The small groups together: every home row against its whole group, some 500,000 pairs at a time.
    start, reach = np.repeat(first, size), np.repeat(size, size)
    homes = np.flatnonzero(home & (reach <= 256))
    work = np.cumsum(reach[homes])
    cuts = np.searchsorted(work, np.arange(500_000, (work[-1] if len(work) else 0) + 500_000, 500_000))
    for part in np.split(homes, np.unique(cuts[cuts < len(homes)])):
        if len(part):
            n = reach[part]
            i = np.repeat(part, n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[part], n)
            near = np.flatnonzero((np.bitwise_count(lead[i] ^ lead[j]) <= min(most_bits, lead_bits)) & (known[i] != known[j]))
            i, j = i[near], j[near]
            close = apart(prints, i, j) <= most_bits
            i, j = i[close], j[close]
            mine = told(i, j)
            out.append((i[mine], j[mine]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def links(nodes: DataFrame, words: int, cover: tuple[Block, ...], within: int, most_bits: int, most: int = MOST, lead_bits: int = 64) -> DataFrame:
    """Pairs of fingerprints (a0, a1, ..., b0, b1, ...) that link, enough of them to join every component.

    nodes: f0, f1, ..., distinct, and perhaps `known`: nodes of one value of it are joined already, and no links between these are given.
    `most_bits` holds over all words together. With several words, those that meet in a block of one word
    are first held against each other by the next word, with lead_bits.
    """
    spark = nodes.sparkSession
    names = [f"f{k}" for k in range(words)]
    sent = [*names, *(["known"] if "known" in nodes.columns else [])]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2_000):
                _, keys, _ = anchors(_matrix(whole.slice(at, 2_000), names), cover, within)
                kind, count = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(count)], names=["key", "rows"])

    # Anchors over the bound. The list has as many rows as there are anchors at most, 2^(bits - 4) a block: 655,360 for 64 bits in three blocks.
    counts = nodes.select(*names).mapInArrow(tally, "key bigint, rows bigint").groupBy("key").agg(F.sum("rows").alias("rows"))
    hot = counts.where(F.col("rows") > most).toArrow().sort_by("key")
    hot_keys = hot.column("key").to_numpy()
    hot_parts = -(-hot.column("rows").to_numpy() // most)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2_000):
                part = whole.slice(at, 2_000)
                prints = _matrix(part, names)
                row, key, home = anchors(prints, cover, within)
                pair = np.zeros(len(row), dtype=np.int64)
                if len(hot_keys):  # each row of a hot anchor goes to every pair of parts that has its own part
                    spot = np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)
                    parts = np.where(hot_keys[spot] == key, hot_parts[spot], 1)
                    mine = (prints[row, 0] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
                    row, key, home, mine, each = (np.repeat(x, parts) for x in (row, key, home, mine, parts))
                    other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                    pair = np.minimum(mine, other) * each + np.maximum(mine, other)
                group = ((key << 35 | pair) << 1) | home
                yield pa.RecordBatch.from_arrays([pa.array(group), *(part.column(x).take(pa.array(row)) for x in sent)], names=["g", *sent])

    dealt = nodes.select(*sent).mapInArrow(spread, "g bigint, " + ", ".join(f"{x} bigint" for x in sent))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(parts, F.shiftright("g", 1)).sortWithinPartitions("g")
    ends = [f"{side}{k}" for side in "ab" for k in range(words)]
    next_word = np.array([(b.word + 1) % words for b in cover])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def settle(run: pa.Table) -> pa.RecordBatch:
            g = run.column("g").to_numpy()
            prints = _matrix(run, names)
            block = (g >> 36) & 31
            lead = prints[np.arange(len(g)), next_word[block]]
            known = run.column(sent[-1]).to_numpy() if len(sent) > words else np.arange(len(g))
            i, j = compare(g >> 1, prints, (g & 1).astype(bool), most_bits, lambda i, j: here(prints, i, j, block[i], cover, within), lead, lead_bits, known)
            both = np.unique(np.concatenate([prints[np.maximum(i, j)], prints[np.minimum(i, j)]], axis=1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in both.T], names=ends)

        for batch in batches:
            if len(batch):
                rest.append(batch)
                g = batch.column("g").to_numpy() >> 1
                at = int(np.searchsorted(g, g[-1]))
                if at:  # all but the last group are complete
                    yield settle(pa.Table.from_batches([*rest[:-1], batch.slice(0, at)]))
                    rest = [batch.slice(at)]
        if rest:
            yield settle(pa.Table.from_batches(rest))

    return dealt.mapInArrow(meet, ", ".join(f"{x} bigint" for x in ends)).distinct()


def _matrix(rows: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([rows.column(x).to_numpy() for x in names], axis=1).view(np.uint64)


def near_duplicates(documents: DataFrame, shingle: int = 4, seed: int = 42, most_bits: int = 4, blocks: int = 3, most: int = MOST) -> DataFrame:
    """doc_id, f0 and component_id (the smallest doc_id reachable over links) of every document.

    Two fingerprints link if they differ in at most most_bits. A component's nodes are (is its least_id null, least_id, fingerprint), so its
    smallest node names it, and no join by component is needed.
    """
    prints = cut(fingerprinted(documents, shingle, (seed,)))
    nodes = cut(prints.groupBy("f0").agg(F.min("doc_id").alias("least_id")).select("f0", F.struct(F.col("least_id").isNull().alias("none"), "least_id", "f0").alias("node")))
    found = links(nodes.select("f0"), 1, whole_cover(blocks), most_bits // blocks, most_bits, most)
    side = lambda x: nodes.select(F.col("f0").alias(f"{x}0"), F.col("node").alias(x))
    roots = components(found.join(side("a"), "a0").join(side("b"), "b0").select("a", "b"))
    named = nodes.join(roots, nodes["node"] == roots["a"], "left").select("f0", F.coalesce("b", "node")["least_id"].alias("component_id"))
    return prints.join(named, "f0").select("doc_id", "f0", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """One document of each group of near_duplicates(), the one of the smallest doc_id, with all its columns.

    Rows that repeat a doc_id are one document: they stay or go together. Rows without a doc_id stay.
    """
    found = near_duplicates(documents, **options)
    return without(documents, "doc_id", found.where("doc_id > component_id").select("doc_id"))


ORACLE_SQL = None
