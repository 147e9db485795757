"""Token counts by section, attributed through offsets.

A document is encoded once, as a whole, by a byte-level BPE. Token lengths in bytes add up to token spans, section
lengths to section spans, and the two sorted lists are joined as intervals. A section is a line with its line feed,
or a field of a row whose fields are encoded as one text.

A token that crosses a boundary is allocated by a stated rule: `first` (the production rule) gives it to the section of
its first byte, `most` to the one that holds most of its bytes (the earlier of equals), `share` divides it by bytes.
Under each rule a document's section counts add up to its tokens.

Documents are independent, so nothing is shuffled. Defined cases: null text counts as empty; an empty text has no
sections and no tokens; special tokens' names in a text are ordinary text; repeated rows and null ids are counted as
they are; a text of any length is encoded whole (one array of token ends a text); a token that crosses into several sections
with equal shares goes to the earliest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import table

NAME = "op9_token_counts"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding and the bytes of each of its tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def token_ends(text: str, path: str = VOCABULARY) -> np.ndarray:
    """The byte at which each token of the text ends."""
    encoding, sizes = encoder(path)
    return np.cumsum(sizes[encoding.encode_ordinary(text)])


def line_ends(data: bytes) -> np.ndarray:
    """The byte at which each line, line feed included, ends."""
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    return ends if not data or (len(ends) and ends[-1] == len(data)) else np.append(ends, len(data))


def attribute(tokens: np.ndarray, sections: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary; both lists are of ends, of the same total."""
    count = len(sections)
    if not len(tokens):
        return np.zeros(count), 0
    begin = np.append(0, tokens[:-1])
    first = np.searchsorted(sections, begin, side="right")
    last = np.searchsorted(sections, tokens, side="left")
    crossing = first != last
    inside = np.bincount(first[~crossing], minlength=count).astype(float)
    if rule == "first":
        return np.bincount(first, minlength=count).astype(float), int(crossing.sum())
    for a, b, i, j in zip(begin[crossing], tokens[crossing], first[crossing], last[crossing], strict=True):
        cuts = np.concatenate([[a], sections[i:j], [b]])
        held = np.diff(cuts)
        if rule == "most":
            inside[i + int(held.argmax())] += 1
        elif rule == "share":
            inside[i : j + 1] += held / (b - a)
        else:
            raise ValueError(f"no rule {rule}")
    return inside, int(crossing.sum())


def _result(key: pa.Array, texts: list[list[str]] | None, whole: list[str], path: str, rule: str) -> pa.RecordBatch:
    rows = []
    for k, text in enumerate(whole):
        data = text.encode("utf-8")
        ends = line_ends(data) if texts is None else np.cumsum([len(x.encode("utf-8")) for x in texts[k]])
        tokens = token_ends(text, path)
        counts, crossing = attribute(tokens, ends, rule)
        rows.append((len(data), len(tokens), len(ends), crossing, counts))
    kind = pa.float64() if rule == "share" else pa.int32()
    counts = [r[4] if rule == "share" else r[4].astype(np.int32) for r in rows]
    arrays = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    return pa.RecordBatch.from_arrays([key, *arrays, pa.array(counts, pa.list_(kind))], names=["doc_id", "n_bytes", "n_tokens", "n_sections", "n_crossing", "section_tokens"])


def _types(df: DataFrame, key: str, rule: str) -> str:
    return f"doc_id {df.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, n_sections bigint, n_crossing bigint, section_tokens array<{'double' if rule == 'share' else 'int'}>"


def by_line(documents: DataFrame, path: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_sections, n_crossing and the tokens of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                yield _result(part.column(0), None, [x or "" for x in part.column(1).to_pylist()], path, rule)

    return documents.select("doc_id", "text").mapInArrow(run, _types(documents, "doc_id", rule))


def by_field(rows: DataFrame, key: str, fields: list[str], path: str = VOCABULARY, rule: str = "first") -> DataFrame:
    """The same with the row's fields, joined without a separator, as sections; null fields are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                texts = [[x or "" for x in r] for r in zip(*(part.column(1 + i).to_pylist() for i in range(len(fields))), strict=True)]
                yield _result(part.column(0), texts, ["".join(x) for x in texts], path, rule)

    return rows.select(key, *fields).mapInArrow(run, _types(rows, key, rule))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_line(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE_SQL = None
