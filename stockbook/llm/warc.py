"""WARC archives of pages: writing, and reading them back sequentially.

Writing: each task writes archive files of its own, one gzip member per
record, under names no other attempt uses, and reports the finished files; only
reported files belong to the result, so a lost or repeated task leaves nothing
that is read. Files go through ``pyarrow.fs`` to the shared folder.

Among records with equal payloads of at least ``min_bytes`` bytes the one with
the largest page_id is a ``response``; the others are ``revisit`` records with
headers only.

Reading: a file is read in chunks. Each gzip member is inflated incrementally,
the record's header gives the length of its block, the block is taken as its
bytes arrive, and payload digests are verified. At most one record is held.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stage, table

MIN_BYTES = 1000
FILE_BYTES = 64 << 20
CHUNK = 64 << 10
BROADCAST_ROWS = 200_000
# The record format's names.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

_FILES = "path string, records bigint, bytes bigint"
RECORD = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
          "payload_digest string, verified boolean, payload binary")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _from_urn(urn: str | None) -> int | None:
    name = urn[10:-1] if urn else "null"
    return None if name == "null" else int(name)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, record_type: str,
                 refers_to: int | None) -> bytes:
    """One record as a gzip member. The block is an HTTP response: its headers
    (with the full payload's length) and, unless a revisit, the payload."""
    body = b"" if record_type == "revisit" else payload
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
             ).encode() + body
    head = [("WARC-Type", record_type), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE),
            ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"),
            ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if url is not None:
        head.insert(3, ("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]-._~%")))
    if record_type == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    text = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(VERSION + b"\r\n" + text + b"\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    out = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        if name:
            out[name.decode().lower()] = value.strip().decode()
    return out


class _Record:
    """Frames one record from inflated bytes as they arrive."""

    def __init__(self) -> None:
        self._buffer = bytearray()
        self.head: dict[str, str] | None = None
        self._length = 0

    def feed(self, data: bytes) -> None:
        self._buffer += data
        if self.head is None and (at := self._buffer.find(b"\r\n\r\n")) >= 0:
            if not self._buffer.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            self.head = _fields(bytes(self._buffer[:at]))
            self._length = int(self.head["content-length"])
            del self._buffer[:at + 4]

    def block(self) -> bytes:
        if self.head is None or len(self._buffer) != self._length + 4 or self._buffer[self._length:] != b"\r\n\r\n":
            raise ValueError("a record does not end where its Content-Length says")
        return bytes(self._buffer[:self._length])


def read_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each gzip member of a byte stream."""
    inflate, record = zlib.decompressobj(31), _Record()
    started = False
    for chunk in chunks:
        while chunk:
            started = True
            record.feed(inflate.decompress(chunk))
            chunk = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                yield record.head, record.block()
                inflate, record, started = zlib.decompressobj(31), _Record(), False
    if started:
        raise ValueError("the archive ends inside a record")


def parse(head: dict[str, str], block: bytes) -> tuple:
    """The RECORD fields of a read record."""
    kind = head["warc-type"]
    http, _, body = block.partition(b"\r\n\r\n")
    length = int(_fields(http)["content-length"])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    verified = head["warc-block-digest"] == f"sha1:{hashlib.sha1(block).hexdigest()}"
    if kind == "response":
        verified &= len(body) == length and hashlib.sha1(body).hexdigest() == digest
    return (_from_urn(head["warc-record-id"]), head.get("warc-target-uri"), kind,
            _from_urn(head.get("warc-refers-to")), length, digest, verified, body if kind == "response" else None)


def with_record_types(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(page_id, url, payload, record_type, refers_to)``.

    The payload is the html in UTF-8 (null: empty). Rows that share the largest
    page_id of their payload are all responses; a null page_id refers to the
    largest, unless all are null. Only digests of payloads met more than once
    are joined back: broadcast if at most BROADCAST_ROWS, else shuffled.
    """
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    size, digest = F.octet_length("payload"), F.sha1("payload")
    repeated = stage(base.where(size >= min_bytes).select("page_id", digest.alias("digest")).groupBy("digest")
                     .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1")
                     .select("digest", "largest"), "repeated")
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = (base.withColumn("digest", F.when(size >= min_bytes, digest))
              .join(F.broadcast(repeated) if few else repeated, "digest", "left"))
    again = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("largest")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``records`` below ``folder`` and return the finished files
    ``(path, records, bytes)`` as a staged table. A file ends once it has
    ``file_bytes`` compressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in
                             ("page_id", "url", "payload", "record_type", "refers_to")), strict=True):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, at = fs.FileSystem.from_uri(path)
                    out = store.open_output_stream(at, compression=None)
                data = record_bytes(*row)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        for p, k, b in done:
            yield pa.record_batch([pa.array([p]), pa.array([k], pa.int64()), pa.array([b], pa.int64())],
                                  names=["path", "records", "bytes"])

    spark = records.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return stage(records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, _FILES), "files")


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records (RECORD) of the archives ``files (path)``; a damaged or cut
    archive raises. Without ``payloads`` only digests leave the reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as f:
                    for head, block in read_records(iter(lambda f=f: f.read(CHUNK), b"")):
                        row = parse(head, block)
                        if not payloads:
                            row = (*row[:-1], None)
                        rows.append(row)
                        size += len(block) if payloads else 1
                        if size > (8 << 20) or len(rows) >= 5000:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    schema = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
              ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()),
              ("payload", pa.binary())]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schema, strict=True)],
                               names=[n for n, _ in schema])

    n = max(1, min(files.count(), 10_000))
    return files.select("path").repartition(n, "path").mapInArrow(run, RECORD)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` through WARC archives and back. A record whose
    digest does not verify fails the query."""
    pages = table(spark, sf_dir, "pages")
    files = write_archives(with_record_types(pages), f"{scratch(spark)}/warc")
    records = read_archives(files, payloads=False)
    sound = F.when(F.col("verified"), F.col("payload_digest")).otherwise(
        F.raise_error(F.lit("a record's digest does not verify")))
    return records.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")
