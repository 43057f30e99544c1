"""WARC archives: one gzip member for each record, written and read back sequentially.

Each task writes one archive under a temporary name and renames it when it is complete, so a task that is run again leaves
no half archive behind. Reading inflates a member piece by piece, frames the block by Content-Length and verifies both
digests; it never holds more than one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, slices, small, written

#: Rows up to which the table of revisits is broadcast.
BROADCAST_ROWS = 500_000
CHUNK = 1 << 16
#: Records carry no time of their own; a fixed date makes archives reproducible.
DATE = "2024-01-01T00:00:00Z"
#: Payload bytes (uncompressed) that one archive holds, about.
ARCHIVE_BYTES = 256 << 20


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _value(text: str | None) -> str:
    """A header value on one line."""
    return " ".join((text or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A gzip member with a response, or with a revisit of another record that has the same payload."""
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _value(url)),
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    data = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


class BadArchive(ValueError):
    pass


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The inflated gzip members of a stream, each fed to zlib in CHUNK bytes."""
    rest = b""
    while rest or (rest := stream.read(CHUNK)):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest and not (rest := stream.read(CHUNK)):
                raise BadArchive("the archive ends within a member")
            try:
                out.append(inflate.decompress(rest))
            except zlib.error as e:
                raise BadArchive(str(e)) from e
            rest = inflate.unused_data
        yield b"".join(out)


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record; both digests are verified."""
    for data in members(stream):
        end = data.find(b"\r\n\r\n")
        lines = data[: max(end, 0)].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise BadArchive(f"no record at {data[:20]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n :] != b"\r\n\r\n":
            raise BadArchive(f"{head['warc-record-id']}: the block isn't as long as said")
        if head["warc-block-digest"] != f"sha1:{digest32(block)}":
            raise BadArchive(f"{head['warc-record-id']}: block digest")
        if head["warc-type"] == "response" and head["warc-payload-digest"] != f"sha1:{digest32(block[block.find(b'\r\n\r\n') + 4 :])}":
            raise BadArchive(f"{head['warc-record-id']}: payload digest")
        yield head, block


def _page(urn: str | None) -> int | None:
    n = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def row_of(head: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url. A revisit says its payload's length in its HTTP head."""
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[: block.find(b"\r\n\r\n")].decode().split("\r\n")[1:])}
    return _page(head["warc-record-id"]), int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], _page(head.get("warc-refers-to")), head["warc-target-uri"]


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html) of pages with refers_to: the smallest page_id whose payload is equal, null for that page itself and for payloads under min_bytes.

    Payloads count as equal by SHA-256. Only digests and ids are shuffled for this; rows that repeat a page_id with the
    smallest id are all responses. A null page_id comes after all others.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_bytes)
    keys = written(keys.select("page_id", "digest"), "digests")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").select("digest", "refers_to")
    revisits = written(keys.join(small(first, BROADCAST_ROWS), "digest").where("page_id is null or page_id != refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")
    mine = F.sha2(payload, 256)
    own = pages.select("page_id", "url", "html", mine.alias("digest")).alias("p")
    again = small(revisits, BROADCAST_ROWS).alias("r")
    met = own.join(again, F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest")), "left")
    return met.select("p.page_id", "p.url", "p.html", "r.refers_to")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archives into a shared folder (any URI that pyarrow opens): a row (path, records) for each.

    A task rolls over to a new archive after ARCHIVE_BYTES of payload.
    """
    spark = pages.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)  # a path without a scheme is on the cluster's default file system
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    folder = f"file://{folder.removeprefix('file:')}" if re.match("file:/(?!//)", folder) else folder

    def run(batches):
        part = TaskContext.get().partitionId()
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, temp, n, size, roll = None, "", 0, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            name = f"{base}/pages-{part:06d}-{roll:04d}.warc.gz"
            fs.move(temp, name)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rpartition('/')[2]}"], "records": [n]})

        for batch in slices(batches, "html"):
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    temp = f"{base}/.{uuid.uuid4().hex}"
                    out, n, size = fs.open_output_stream(temp), 0, 0
                payload = (html or "").encode()
                out.write(record(page, url, payload, refers))
                n, size = n + 1, size + len(payload)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out, roll = None, roll + 1
        if out is not None:
            yield close()

    return written(with_first(pages, min_bytes).select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long")).mapInArrow(run, "path string, records long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives in the column `path`."""

    def run(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(name, compression=None) as stream:
                    rows: list[tuple] = []
                    for head, block in records(stream):
                        rows.append(row_of(head, block))
                        if len(rows) == 5000:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    # an archive is a unit of work: paths are dealt out in turn, whatever files list them
    spread = archives.select("path").repartition(max(1, min(archives.count(), 10_000)))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, then read the archives back."""
    folder = folder or f"{shared_dir(spark)}/lodequery-warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder)).drop("url")
