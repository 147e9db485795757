"""WARC output from legacy ARC records.

An ARC file begins with a version block (`filedesc://...`, then `1 0 origin`, `1 1 origin` or `2 0 origin` and the
names of the fields). Each record is a header line (version 1: URL, IP address, date, type, length; version 2:
also result code, checksum, location, offset and file name before the length), the declared number of bytes and a
line feed. URLs may hold spaces, so fields are counted from the right. The converter makes of every record a WARC/1.1
record: a UUID derived from the key as identifier, the ISO form of the date, a response record of HTTP headers and
payload for http(s) documents with such headers (else one whose headers are synthesised), and the SHA-256 digests of
block and payload. Of records with equal payloads of at least MIN_SHARED bytes the one of the smallest key is stored, and the
others become revisit records that refer to it. Of foreign archives, read_arc() and read_warc() hold one file at a time, of 2 GiB at most.

Files are written by Spark's text writer, gzipped: a file is one value of some FILE_BYTES bytes of records at most (or one larger record), and the last
line feed of its last record is the writer's line separator; so the bytes are exact, commits are atomic, memory is bounded by a file or the largest
record on either side, and any file system that Spark reaches will do. Minima by digest are pre-aggregated; the join that brings them back can split a hot digest.

Defined cases: null html is an empty payload; null url is written as `urn:none`; null keys give responses, and are not
referred to; rows that repeat a stored key are responses as well; an empty table gives no records; other columns
are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

NAME = "op6_warc"
MIN_SHARED = 100
FILE_BYTES = 16 << 20
DATE = "20240101000000"
_FIELDS = {1: 5, 2: 10}
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class Arc(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    block: bytes


def parse_record(data: bytes, at: int, version: int) -> tuple[Arc, int]:
    """The record at a place and the place after it. Raises ValueError if the declared length runs past the end."""
    end = data.find(b"\n", at)
    fields = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r").rsplit(" ", _FIELDS[version] - 1)
    if end < 0 or len(fields) != _FIELDS[version] or not fields[-1].isdigit():
        raise ValueError(f"not a version {version} header line at byte {at}")
    start, size = end + 1, int(fields[-1])
    if start + size > len(data):
        raise ValueError(f"the record at byte {at} declares {size} bytes, {len(data) - start} are left")
    return Arc(*fields[:4], data[start : start + size]), start + size + (data[start + size : start + size + 1] == b"\n")


def parse_file(data: bytes) -> Iterator[tuple[int, Arc]]:
    """(byte offset, record) of every record after the version block."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if not data:
        return
    head, at = parse_record(data, 0, 1)
    found = re.match(rb"([12]) \d+ ", head.block)
    if not head.url.startswith("filedesc://") or not found:
        raise ValueError("no version block")
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        start = at
        record, at = parse_record(data, at, int(found[1]))
        yield start, record


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers with their blank line, and payload; no headers if the block has none."""
    if block.startswith(b"HTTP/"):
        ends = [(i + n) for mark, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (i := block.find(mark)) >= 0]
        if ends:
            return block[: min(ends)], block[min(ends) :]
    return b"", block


def iso(date: str) -> str:
    """An ARC date of 8 to 14 digits as a WARC date."""
    d = (date + "000000")[:14] if date.isdigit() and len(date) >= 8 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def identifier(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{key}')}>"


def warc_record(key: object, arc: Arc, refers: object = None) -> bytes:
    """The record without its last line feed; refers: the key of the record that holds the payload."""
    http, payload = split_http(arc.block)
    http = http or f"HTTP/1.1 200 OK\r\nContent-Type: {arc.mime}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    # The head's values are single lines: whatever else would end one becomes a space.
    line = lambda x: re.sub(r"[\r\n]+", " ", str(x))
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {identifier(key)}",
        f"WARC-Date: {iso(arc.date)}",
        f"WARC-Target-URI: {line(arc.url)}",
        f"WARC-IP-Address: {line(arc.ip)}",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if key is not None:
        head.append(f"X-Source-Key: {key}")
    if refers is not None:
        head += [f"WARC-Refers-To: {identifier(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r"


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head, block) of every WARC record, by declared lengths."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if end + 4 + size + 4 > len(data):
            raise ValueError(f"the record at byte {at} is cut short")
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


# ---------------------------------------------------------------- frames


def arc_record(url: Column, payload: Column, version: Column) -> Column:
    """The ARC record of a page, in either version; what would break a header line is escaped."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    size = (F.octet_length(http) + F.octet_length(payload)).cast("string")
    start = F.concat(F.regexp_replace(F.coalesce(url, F.lit("urn:none")), r"[\r\n]", "%0A"), F.lit(f" 0.0.0.0 {DATE} text/html "))
    line = F.when(version == 1, F.concat(start, size)).otherwise(F.concat(start, F.lit("200 - - 0 pages.arc "), size))
    return F.concat(F.concat(line, F.lit("\n"), http).cast("binary"), payload, F.lit("\n").cast("binary"))


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """key (file name and byte offset), arc (the record in version 1 form) and version of every record of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for at, arc in parse_file(data.as_py()):
                    line = " ".join([arc.url, arc.ip, arc.date, arc.mime, str(len(arc.block))]).encode()
                    yield pa.RecordBatch.from_pydict({"key": [f"{name.rsplit('/', 1)[-1]}#{at:012d}"], "arc": pa.array([line + b"\n" + arc.block + b"\n"], pa.binary()), "version": pa.array([1], pa.int32())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "key string, arc binary, version int")


def convert(records: DataFrame, path: str, min_shared: int = MIN_SHARED) -> None:
    """Writes the WARC records of the ARC records (key, arc, version) below path.

    A payload is what follows the HTTP headers; its digest is taken by a first pass that carries no texts.
    """
    kind = records.schema["key"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, version in zip(batch.column("arc"), batch.column("version"), strict=True):
                payload = split_http(parse_record(data.as_py(), 0, version.as_py())[0].block)[1]
                out.append(hashlib.sha256(payload).digest() if len(payload) >= min_shared else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "digest"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        file = lambda: pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary())], names=["records"])
        for batch in batches:
            for key, data, version, first in zip(*(batch.column(x) for x in ("key", "arc", "version", "first")), strict=True):
                key, first = key.as_py(), first.as_py()
                refers = None if key is None or first is None or first == key else first
                record = warc_record(key, parse_record(data.as_py(), 0, version.as_py())[0], refers)
                if held and size + len(record) > FILE_BYTES:
                    yield file()
                    held, size = [], 0
                held.append(record)
                size += len(record) + 1
        if held:
            yield file()

    marked = records.select("key", "arc", "version").mapInArrow(digests, f"key {kind}, arc binary, version int, digest binary")
    shared = marked.where("digest is not null").groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    out = marked.join(shared, "digest", "left").select("key", "arc", "version", "first").mapInArrow(write, "records binary")
    out.select(F.col("records").cast("string").alias("value")).write.option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def read_warc(spark: SparkSession, path: str, key_type: str = "bigint") -> DataFrame:
    """key, record_id, record_type, refers_id, payload_bytes and payload_digest (of what the record holds; the head's digest in a revisit)."""
    cast = int if key_type == "bigint" else str
    arrow = pa.int64() if key_type == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for head, block in read_records(data.as_py()):
                    _, payload = split_http(block)
                    kept = head["warc-type"] == "response"
                    digest = hashlib.sha256(payload).hexdigest() if kept else head["warc-payload-digest"].rpartition(":")[2]
                    if kept and not head["warc-payload-digest"].endswith(digest):
                        raise ValueError(f"{head['warc-record-id']}: the payload doesn't have its digest")
                    rows.append((cast(head["x-source-key"]) if "x-source-key" in head else None, head["warc-record-id"], head["warc-type"], head.get("warc-refers-to"), len(payload) if kept else None, digest))
                kinds = (arrow, pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "record_id", "record_type", "refers_id", "payload_bytes", "payload_digest"])

    types = f"key {key_type}, record_id string, record_type string, refers_id string, payload_bytes bigint, payload_digest string"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, types)


def resolved(records: DataFrame) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to: revisits take length and key from what they refer to."""
    revisits = records.where("record_type = 'revisit'").select("key", "record_type", "refers_id", "payload_digest")
    stored = records.where("record_type = 'response'")
    wanted = revisits.select(F.col("refers_id").alias("record_id")).distinct()
    once = stored.join(wanted, "record_id", "left_semi").groupBy("record_id").agg(F.min("key").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes"))
    back = revisits.join(once, revisits["refers_id"] == once["record_id"], "left")
    columns = ("key", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return stored.withColumn("refers_to", F.lit(None).cast(records.schema["key"].dataType)).select(*columns).unionAll(back.select(*columns))


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """Pages as legacy records, of either version in turn."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    version = F.when(F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(2)) == 0, 1).otherwise(2)
    return pages.select(F.col("page_id").alias("key"), arc_record(F.col("url"), payload, version).alias("arc"), version.cast("int").alias("version"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    convert(pages_to_arc(table(spark, sf_dir, "pages", "page_id", "url", "html")), path)
    return resolved(read_warc(spark, path)).withColumnRenamed("key", "page_id")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {MIN_SHARED} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
