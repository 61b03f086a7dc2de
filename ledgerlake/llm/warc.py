r"""WARC archives: a writer and a sequential reader.

An archive is a stream of gzip members, one a record. Spark has no sink for byte files, so archives lie in a table
(archive, blocks) in the shared folder, a row of at most about ARCHIVE_BYTES each, its bytes in blocks; they are read
where they lie, without a shuffle. Archives that are files are read by read_files(). The reader takes an archive's bytes
in order, in pieces of any size: zlib inflates them a few KB at a time, a member's end starts the next, a record's header
ends at the empty line, Content-Length frames its block, and the digests are verified: SHA-1, SHA-256, SHA-512 and MD5, as
hex or base32; absent ones pass. Only one record is held at a time. Archives of other writers are read as well: records
that are neither response nor revisit are passed over, and record ids that are no page numbers give a null page_id.

Of records with equal payloads of at least REVISITED bytes that with the smallest page_id is a response, the others are
revisits that name it and carry no payload; the HTTP header that they keep tells the payload's length.

Cases: a null html is the empty payload; rows with a payload's smallest page_id are all responses, so repeated rows are;
a null page_id comes after all others; line ends and other controls in a url are percent-encoded, a null url has no
WARC-Target-URI; a damaged or cut-off archive raises WarcError; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import skewed_left, table, written

REVISITED, BLOCK_BYTES, ARCHIVE_BYTES, DATE = 100, 256 << 10, 4 << 20, "2020-01-01T00:00:00Z"
PIECE = 16 << 10  # bytes that zlib is given at once: what follows a member's end is copied
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = pa.schema([("archive", pa.string()), ("blocks", pa.list_(pa.binary()))])
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """The bytes are no whole, intact archive."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]|%(?=[01][0-9A-F]|20|7F)", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + c.flush()


def _write(batches):
    """Pack records into archives of bounded size, in blocks; a record longer than that is an archive of its own."""
    from pyspark import TaskContext

    part, number, held = TaskContext.get().partitionId(), 0, bytearray()

    def archive():
        nonlocal number
        blocks = [bytes(held[i : i + BLOCK_BYTES]) for i in range(0, len(held), BLOCK_BYTES)]
        held.clear()
        number += 1
        return pa.RecordBatch.from_arrays([pa.array([f"{part}-{number}"]), pa.array([blocks], ARCHIVES.types[1])], schema=ARCHIVES)

    for b in batches:
        for i in range(b.num_rows):
            page_id, url, html, digest, refers_to = (c[i].as_py() for c in b.columns)
            held += record(page_id, url, html, digest, refers_to)
            if len(held) >= ARCHIVE_BYTES:
                yield archive()
    if held:
        yield archive()


def inflate(pieces: Iterable[bytes]) -> Iterator[bytes | None]:
    """The inflated bytes of an archive; None after each gzip member."""
    member = None
    for piece in (p[i : i + PIECE] for p in map(memoryview, pieces) for i in range(0, len(p), PIECE)):
        while piece:
            member = member or zlib.decompressobj(31)
            try:
                out = member.decompress(piece)
            except zlib.error as e:
                raise WarcError(f"bad gzip member: {e}") from e
            if out:
                yield out
            piece = b""
            if member.eof:
                piece, member = member.unused_data, None
                yield None
    if member:
        raise WarcError("the archive ends within a member")


def read_records(pieces: Iterable[bytes]) -> Iterator[Record]:
    """The records of one archive, one gzip member each, with verified digests."""
    held = bytearray()
    for out in inflate(pieces):
        if out is not None:
            held += out
            continue
        end = held.find(b"\r\n\r\n")
        if end < 0 or not held.startswith(b"WARC/"):
            raise WarcError("a member without a WARC header")
        lines = bytes(held[:end]).decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers.get("content-length", -1))
        if size < 0 or bytes(held[end + 4 + size :]) != b"\r\n\r\n":
            raise WarcError("Content-Length does not frame the block")
        got = Record(headers, bytes(held[end + 4 : end + 4 + size]))
        verify(headers.get("warc-block-digest"), "block", got.block)
        held.clear()
        yield got


def verify(told: str | None, what: str, data: bytes) -> str | None:
    """The digest as told, lower-case hex if of SHA-256; refused if it is not that of the data. Absent ones pass, and kinds that hashlib does not know."""
    kind, _, value = (told or "").partition(":")
    if not value or kind.lower() not in ("sha1", "sha256", "md5", "sha512"):
        return told or None
    found = hashlib.new(kind.lower(), data, usedforsecurity=False)
    same = value.lower() in (found.hexdigest(), base64.b32encode(found.digest()).decode().lower().rstrip("="), base64.b32encode(found.digest()).decode().lower())
    if not same:
        raise WarcError(f"{what} digest differs")
    return found.hexdigest() if kind.lower() == "sha256" else told


def _page(r: Record):
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    head, _, payload = r.block.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length: *(\d+)", head)
    kind, digest = r.headers.get("warc-type"), r.headers.get("warc-payload-digest")
    # a revisit's digest is that of the record it refers to
    digest = verify(digest, "payload", payload) if kind == "response" else (digest or "").removeprefix("sha256:") or None
    url = r.headers.get("warc-target-uri")
    url = None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)) if int(m[1], 16) in (*range(33), 37, 127) else m[0], url)
    size = int(told[1]) if told and kind == "revisit" else len(payload)
    return number(r.headers.get("warc-record-id")), url, size, digest, kind, number(r.headers.get("warc-refers-to"))


def _read(batches):
    """Archives, a row each, to records."""
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for b in batches:
        for blocks in b.column(1):
            rows = []
            for r in read_records(x.as_py() for x in blocks.values):
                if r.headers.get("warc-type") not in ("response", "revisit"):
                    continue  # warcinfo, request, metadata and others hold no page
                rows.append(_page(r))
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def write_archives(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to written archives: (archive, blocks)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html")).withColumn("digest", F.sha2("html", 256))
    same = rows.where(F.octet_length("html") >= REVISITED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = written(same, "same")
    typed = skewed_left(rows, same, "digest", same.count() * 96)
    refers_to = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    typed = typed.select("page_id", "url", "html", "digest", refers_to.alias("refers_to"))
    return written(typed.mapInArrow(_write, "archive string, blocks array<binary>"), "archives", "uncompressed")


def read_archives(archives: DataFrame) -> DataFrame:
    return archives.select("archive", "blocks").mapInArrow(_read, RECORDS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives that are files (*.warc.gz). Spark's source of whole files holds each in memory, 2 GB at most."""
    files = spark.read.format("binaryFile").load(path)
    return read_archives(files.select(F.col("path").alias("archive"), F.array("content").alias("blocks")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"))).drop("url")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {REVISITED} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISITED} AND page_id <> first THEN first END AS refers_to
FROM f
"""
