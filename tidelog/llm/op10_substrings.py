"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a place sums table values of the bytes up to it, each shifted by its distance, so it depends on the
last 32 bytes alone. A place whose hash is the smallest within REACH bytes on either side is a boundary, moved on to
the end of the word it is in; chunks hold whole words and are some 2 * REACH bytes long. Boundaries depend on nearby
bytes only, so an insertion changes the chunks around it and no others, and a passage that two texts share has the
same chunks in both, up to its edges.

What is compared is a digest (BLAKE2b, 128 bits) of two neighbouring chunks, a unit, of MIN_UNIT bytes at least; a text of one chunk is one unit. A unit is
repeated if an equal one has a smaller (doc_id, place). Repeated units that follow each other are a run, and a run of MIN_RUN bytes or more
is cut out, both chunks of each of its units: single chunks of a few words agree by chance, and short phrases come again in unrelated texts.
Whatever is cut stands at an earlier place, so the first of all places of every chunk stays.

Scale: a first pass counts units by half their digest, pre-aggregated; those that come more than once are marked in a map of 2^27 bits. The second pass
sends only units that the map lets through, and finds first places among these by the whole digest; minima are pre-aggregated, and all places
that are not among them are repetitions, so that nothing is joined by digest. Texts are shuffled once, to meet their cuts.

Defined cases: null text stays null, an empty one empty; a text of which nothing is left is empty, its row stays; rows that
repeat doc_id and text are one document; null ids come first; a text without white space is cut where the hash says, between
characters, and after MAX_CHUNK bytes at the latest; texts of any length are gone through whole; an empty table gives an empty result; a column
n_cut is replaced, all other columns are kept, n_chars counts the new text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .common import cut, free, table

NAME = "op10_substrings"
REACH, MIN_UNIT, MIN_RUN, MAX_CHUNK, NEXT_SPACE = 20, 40, 120, 2_048, 64
_SLOTS = 1 << 27
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: five doublings of the window, 32 bytes in the end."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h = np.concatenate([h[:step], h[step:] + (h[:-step] << np.uint32(step))])
    return h


def _least_before(h: np.ndarray, reach: int) -> np.ndarray:
    """At i the smallest of h[i - reach : i]; the largest value where there is none."""
    out = np.full(len(h), np.iinfo(h.dtype).max, dtype=h.dtype)
    width, run = 1, h
    done = 0
    while done < reach and len(h) > done:
        take = min(width, reach - done)
        if take < width:  # windows may overlap
            done -= width - take
        shift = done + 1
        if shift < len(h):
            out[shift:] = np.minimum(out[shift:], run[:-shift])
        done += width
        if width * 2 <= reach - done and len(run) > width:
            run = np.concatenate([run[:width], np.minimum(run[width:], run[:-width])])
            width *= 2
    return out


def chunk_ends(text: bytes) -> np.ndarray:
    """The byte at which each chunk of the text ends."""
    data = np.frombuffer(text, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    h = gear(data)
    after = _least_before(h[::-1], REACH)[::-1]
    found = np.flatnonzero((h < _least_before(h, REACH)) & (h <= after))
    spaces = np.flatnonzero(_SPACE[data])
    cuts = _aligned(found, data, spaces)
    cuts = np.unique(np.append(cuts[cuts < len(data)], len(data)))
    wide = np.flatnonzero(np.diff(np.append(0, cuts)) > MAX_CHUNK)
    if len(wide):
        begin = np.append(0, cuts)
        more = [np.arange(begin[k] + MAX_CHUNK, cuts[k], MAX_CHUNK) for k in wide]
        forced = _aligned(np.concatenate(more), data, spaces)
        cuts = np.unique(np.concatenate([cuts, forced[forced < len(data)]]))
    return cuts


def _aligned(places: np.ndarray, data: np.ndarray, spaces: np.ndarray) -> np.ndarray:
    """Behind the next white space if there is one soon, else behind the character."""
    if not len(places):
        return places
    spot = np.searchsorted(spaces, places)
    end = np.append(spaces, len(data) + NEXT_SPACE * 2)[spot] + 1
    plain = places + 1
    for _ in range(3):
        inner = plain < len(data)
        plain = plain + (inner & ((data[np.minimum(plain, len(data) - 1)] & 0xC0) == 0x80))
    return np.where(end - places <= NEXT_SPACE, end, plain)


def units(text: bytes) -> list[tuple[int, bytes]]:
    """(chunk, digest) of every two neighbouring chunks from that chunk on."""
    ends = chunk_ends(text).tolist()
    if len(ends) < 2:
        return [(0, blake2b(text, digest_size=16).digest())] if len(text) >= MIN_RUN else []
    starts = [0, *ends]
    return [(i, blake2b(text[starts[i] : ends[i + 1]], digest_size=16).digest()) for i in range(len(ends) - 1) if ends[i + 1] - starts[i] >= MIN_UNIT]


def without(text: str, repeats: list[int]) -> tuple[str, int]:
    """The text without the long runs of the units that begin at the chunks in `repeats`, and how many units were cut."""
    data = text.encode("utf-8")
    ends = chunk_ends(data).tolist()
    starts, last = [0, *ends], len(ends) - 1
    gone, count, at = set(), 0, 0
    while at < len(repeats):
        to = at
        while to + 1 < len(repeats) and repeats[to + 1] == repeats[to] + 1:
            to += 1
        a, b = repeats[at], min(repeats[to] + 1, last)
        if ends[b] - starts[a] >= MIN_RUN:
            gone.update(range(a, b + 1))
            count += to - at + 1
        at = to + 1
    return b"".join(data[starts[i] : ends[i]] for i in range(len(ends)) if i not in gone).decode("utf-8") if gone else text, count


def repeated(documents: DataFrame) -> DataFrame:
    """doc_id, text_mark and repeats: the units of each document that occur at an earlier place."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    marked = documents.where("text is not null").select("doc_id", "text", _mark())

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                texts = whole.column("text").slice(at, 500).to_pylist()
                digests = b"".join(d for text in texts for _, d in units(text.encode("utf-8")))
                half, count = np.unique(np.frombuffer(digests, dtype=np.int64)[0::2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(half), pa.array(count)], names=["half", "n"])

    often = marked.select("text").mapInArrow(halves, "half bigint, n bigint").groupBy("half").agg(F.sum("n").alias("n")).where("n > 1")
    slot = F.pmod("half", F.lit(_SLOTS))
    maps = often.groupBy(F.shiftright(slot, 15).alias("k")).agg(F.bitmap_construct_agg(slot % (1 << 15)).alias("bits"))
    held = np.zeros((_SLOTS >> 15, 1 << 12), dtype=np.uint8)
    for r in maps.toLocalIterator():  # 4,096 pieces of 4 KiB at most
        held[r["k"]] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    held = held.reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                row, place, digests = [], [], []
                marks = batch.column("text_mark").to_pylist()
                for k, text in enumerate(batch.column("text").to_pylist()):
                    for i, digest in units(text.encode("utf-8")):
                        row.append(k), place.append(marks[k] << 32 | i), digests.append(digest)
                two = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                x = two[:, 0] % _SLOTS
                some = np.flatnonzero(held[x >> 3] >> (x & 7).astype(np.uint8) & 1)
                ids = batch.column("doc_id").take(pa.array(np.array(row, dtype=np.int64)[some]))
                yield pa.RecordBatch.from_arrays([pa.array(two[some, 0]), pa.array(two[some, 1]), ids, pa.array(np.array(place, dtype=np.int64)[some])], names=["d0", "d1", "doc_id", "place"])

    rows = cut(marked.mapInArrow(run, f"d0 bigint, d1 bigint, doc_id {kind}, place bigint"))
    # Whatever is nobody's first place is a repetition. Places spread evenly, however hot a digest is; a digest that comes once is its own first.
    first = rows.groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "place")).alias("first")).select(F.col("first.doc_id").alias("first_id"), F.col("first.place").alias("first_place"))
    later = rows.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("place") == F.col("first_place")), "left_anti")
    return later.groupBy("doc_id", F.shiftright("place", 32).cast("int").alias("text_mark")).agg(F.sort_array(F.collect_set(F.col("place").bitwiseAND(0xFFFFFFFF).cast("int"))).alias("repeats"))


def _mark():
    """31 bits of the text's hash, to tell apart texts under one id."""
    return F.xxhash64("text").bitwiseAND(0x7FFFFFFF).cast("int").alias("text_mark")


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents with every repeated passage left out but at its first place; the columns are the same, and n_cut units were cut."""
    documents = documents.drop("n_cut")
    same, theirs, own, gone = free(documents, "cut_id", "cut_mark", "own_mark", "repeats")
    found = repeated(documents).select(F.col("doc_id").alias(same), F.col("text_mark").alias(theirs), F.col("repeats").alias(gone))
    frame = documents.withColumn(own, _mark())
    met = frame.join(found, F.col("doc_id").eqNullSafe(F.col(same)) & (F.col(own) == F.col(theirs)), "left").drop(own, theirs, same)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.schema.get_field_index("text")
            repeats = batch.column(batch.schema.get_field_index(gone))
            new = [without(t.as_py(), c.as_py()) if c.is_valid else (t.as_py(), 0) for t, c in zip(batch.column(spot), repeats, strict=True)]
            columns = [pa.array([x[0] for x in new], pa.string()) if x == "text" else batch.column(batch.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in new], pa.int32())], names=[*names, "n_cut"])

    out = met.mapInArrow(run, StructType(list(documents.schema.fields)).add("n_cut", IntegerType()))
    return out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE_SQL = None
