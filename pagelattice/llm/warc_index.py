"""WARC archives, index first: write records and an index, then read selected records by coalesced byte ranges.

Every task writes archives of bounded size, one gzip member a record, under names of its own attempt; the
index lists what committed tasks wrote: archive, offset, length, URL, digest. Reading sorts the selected rows
of the index by archive and offset and fetches neighbours in one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, scratch, small_batches, staged

#: Payloads below this many bytes are always stored.
LEAST_BYTES = 1000
#: Bytes of an archive after which a new one begins; gap up to which two ranges are read as one; most bytes of a read.
ARCHIVE, GAP, READ = 256 << 20, 64 << 10, 8 << 20
#: Bytes of records that a reading task gets.
TASK = 16 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload (binary), payload_bytes, digest, refers_to (null for a response).

    Of equal payloads of at least ``least`` bytes the row with the largest page_id is stored. Null html is
    an empty payload. Copies of that row are stored as well. If all have a null page_id, each is stored.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    groups = p.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("stored"), F.count("*").alias("n")).where("n > 1").drop("n")
    p = p.join(checked_broadcast(staged(groups)), ["digest", "payload_bytes"], "left")
    return p.select("page_id", "url", "payload", "payload_bytes", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("stored")), F.col("stored")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC 1.1 record: response with its HTTP block, or revisit of an equal payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block, whose digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict((k.lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines))
    block = rest[: int(fields["content-length"])]
    if not first.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or fields["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("a record that is not as it was written")
    return fields, block


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write all records of ``plan`` under ``folder`` (a URI all executors reach); returns the staged index."""
    small_batches(records.sparkSession)
    kind = dict(records.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]):
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    data = zlib.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["payload_bytes"], r["refers_to"]), 1, wbits=31)
                    if out is None or at + len(data) > ARCHIVE:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(data)
                    rows.append((r["page_id"], name, at, len(data), r["url"], r["digest"]))
                    at += len(data)
                cols = list(zip(*rows, strict=True)) or [()] * 6
                types = (b.schema.field("page_id").type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["page_id", "archive", "offset", "length", "url", "digest"])
        finally:
            if out is not None:
                out.close()

    return staged(records.mapInArrow(run, f"page_id {kind}, archive string, offset long, length long, url string, digest string"))


def ranges(rows: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(first, after the last, offset, bytes) of the reads for sorted (offset, length) of one archive."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(rows):
        if out and offset - (out[-1][2] + out[-1][3]) <= GAP and offset + length - out[-1][2] <= READ:
            a, _, begin, have = out[-1]
            out[-1] = (a, i + 1, begin, max(have, offset + length - begin))
        else:
            out.append((i, i + 1, offset, length))
    return out


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` selects: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    A revisit has no payload of its own; its digest and size are those of the payload it refers to.
    """
    # as many tasks as the records' bytes ask for: the index itself is small, and would be read by a task or two
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    wanted = index.select("archive", "offset", "length").repartitionByRange(max(1, -(-size // TASK)), "archive", "offset").sortWithinPartitions("archive", "offset")
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    number = lambda uri: int(uri[len("<urn:page:") : -1]) if len(uri) > len("<urn:page:>") else None

    def run(batches: Iterator[pa.RecordBatch]):
        files, path = _files(folder)
        opened, source = "", None
        for b in batches:
            names_, at, size = (b.column(c).to_pylist() for c in ("archive", "offset", "length"))
            i = 0
            while i < len(names_):
                j = i
                while j < len(names_) and names_[j] == names_[i]:
                    j += 1
                if names_[i] != opened:
                    if source is not None:
                        source.close()
                    opened, source = names_[i], files.open_input_file(f"{path}/{names_[i]}")
                for a, z, begin, have in ranges(list(zip(at[i:j], size[i:j], strict=True))):
                    data, rows = source.read_at(have, begin), []
                    for k in range(i + a, i + z):
                        f, block = parse(zlib.decompress(data[at[k] - begin : at[k] - begin + size[k]], wbits=31))
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length:")[2])
                        digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if f["warc-type"] == "response" and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError("a payload that is not as it was written")
                        refers = number(f["warc-refers-to"]) if "warc-refers-to" in f else None
                        rows.append((number(f["warc-record-id"]), f["warc-target-uri"], f["warc-type"], digest, length, refers, body if f["warc-type"] == "response" else None))
                    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                i = j
        if source is not None:
            source.close()

    return wanted.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def archive_and_read(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and read all records back.

    Null url: an empty target. Empty table: no rows. Repeated rows are records of their own.
    """
    folder = scratch(pages.sparkSession)
    return read(write(plan(pages, least), folder), folder)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS stored FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> stored THEN stored END AS refers_to FROM m
"""
