"""WARC: converter from legacy ARC archives, and reader of what it wrote.

ARC files hold one header line per record, whose fields depend on the version
named by the file's ``filedesc`` record (five fields in version 1, ten in
version 2), then a block of the declared length.  The converter parses them
and synthesises WARC records: a name-based UUID from archive and offset, the
ISO form of the 14-digit date, type ``response`` or ``revisit`` (equal
payloads of at least ``min_bytes`` bytes: the record with the largest page id
stays a response, the others refer to it), payload and block SHA-1 digests.

Archives are written by Spark's text sink, one archive per row and file, and
read by its binary-file source, so any file system Spark knows will do and
lost tasks are simply run again.  An archive holds about ``ARCHIVE_BYTES``
bytes (more only for a single larger record), which bounds a task's memory.
Only digests are grouped (partial aggregation); blocks meet their decision in
one join, whose skewed digests Spark splits.

Defined results: null html is an empty payload; a null url is written as
``-``; white space and controls in urls are percent-encoded; a null page id
ranks below all others and reads back as null; repeated rows are records of
their own (of equal page ids the first in archive order is the response);
an empty table gives no archives and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelink.session import shared_dir

ARCHIVE_BYTES = 16 << 20
CHUNK_BYTES = 8 << 20      # payload bytes per batch handed back to Spark
CAPTURE_DATE = "20240101000000"

#: Fixed field names of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
_HEADER_END = b"\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC -----------------------------------------------------------------

def arc_record(version: int, url: str | None, block: bytes, *, date: str = CAPTURE_DATE, ip: str = "0.0.0.0",
               mime: str = "text/html", offset: int = 0, filename: str = "-") -> bytes:
    """One ARC record: header line, block, closing newline."""
    safe = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], (url or "-").encode()) or b"-"
    middle = f"{ip} {date} {mime}" if version == 1 else f"{ip} {date} {mime} 200 - - {offset} {filename}"
    return b"%s %s %d\n%s\n" % (safe, middle.encode(), len(block), block)


def arc_filedesc(version: int, name: str) -> bytes:
    about = f"{version} 0 tidelink\n{ARC_FIELDS[version]}\n\n".encode()
    return arc_record(version, f"filedesc://{name}", about, mime="text/plain", filename=name)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC archive in order, by declared lengths.

    A header line that does not parse, or a length beyond the end, ends the
    archive with an error: the rest could not be located.
    """
    at, name, fields = 0, "", 5
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        parts = data[at:stop].rstrip(b"\r").decode("utf-8", "replace").split(" ") if stop > 0 else []
        if data.startswith(b"filedesc://", at) and stop > 0:
            version = int(data[stop + 1:stop + 2] or b"1")
            fields, name = len(ARC_FIELDS[version].split()), parts[0][len("filedesc://"):]
        if len(parts) < fields or not parts[-1].isdigit() or stop + 1 + int(parts[-1]) > len(data):
            raise ValueError(f"ARC record at byte {at} of {name or 'archive'} has no valid header line")
        rest = parts[len(parts) - fields + 1:]
        block = data[stop + 1:stop + 1 + int(parts[-1])]
        if not parts[0].startswith("filedesc://"):
            yield {"archive": name, "offset": at, "version": 1 if fields == 5 else 2,
                   "url": " ".join(parts[:len(parts) - fields + 1]), "ip": rest[0], "date": rest[1], "mime": rest[2],
                   "block": block}
        at = stop + 1 + len(block) + 1


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Header bytes (with the blank line) and payload of an HTTP block; no header: all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(_HEADER_END)
    return (block, b"") if end < 0 else (block[:end + 4], block[end + 4:])


def http_field(head: bytes, name: bytes) -> int | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(-?\d+)[ \t]*\r$", head)
    return int(found[1]) if found else None


# --- WARC ----------------------------------------------------------------

def record_urn(archive: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}"


def iso_date(date14: str) -> str:
    d = date14.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
             ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_info(name: str) -> bytes:
    return warc_record("warcinfo", [("WARC-Record-ID", f"<{record_urn(name, 0)}>"),
                                    ("WARC-Date", iso_date(CAPTURE_DATE)), ("WARC-Filename", name),
                                    ("Content-Type", "application/warc-fields")],
                       b"software: tidelink\r\nformat: WARC File Format 1.0\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower-case) and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(_HEADER_END, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = end + 4
        stop = start + int(fields["content-length"])
        if stop > len(data):
            raise ValueError(f"WARC record at byte {at} is cut off")
        yield fields, data[start:stop]
        at = stop + 4


# --- Spark ---------------------------------------------------------------

def _inflate(data: bytes) -> bytes:
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


def _archive(parts: list[bytes]) -> pa.RecordBatch:
    """One archive as a row, without its last newline: the text sink writes that."""
    return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], names=["content"])


def _write_archives(archives: DataFrame, path: str) -> None:
    (archives.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1)
     .option("compression", "gzip").text(path))


def _read_archives(spark: SparkSession, path: str) -> DataFrame:
    # Empty folders (no archive written) hold no matching file and give no rows.
    return (spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
            .option("pathGlobFilter", "*.gz").load(path).select("content"))


def _batches(rows: Iterator[tuple], fields: list[pa.Field], weight) -> Iterator[pa.RecordBatch]:
    """Group row tuples to batches of about ``CHUNK_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + weight(row)
        if size >= CHUNK_BYTES:
            yield _batch(held, fields)
            held, size = [], 0
    if held:
        yield _batch(held, fields)


def _batch(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)],
                                      names=[f.name for f in fields])


def write_arc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
              payload_col: str = "html") -> None:
    """Write pages as ARC archives, versions 1 and 2 in turn; the page id goes into the HTTP header."""

    def run(batches):
        part = TaskContext.get().partitionId()
        number, size, parts = 0, 0, []
        for batch in batches:
            for page_id, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                payload = payload or b""
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
                if page_id is not None:
                    head += b"X-Page-Id: %d\r\n" % page_id
                block = head + b"\r\n" + payload
                if parts and size + len(block) > ARCHIVE_BYTES:
                    yield _archive(parts)
                    number, parts = number + 1, []
                name, version = f"pages-{part:06d}-{number:06d}.arc", 1 + (part + number) % 2
                if not parts:
                    parts.append(arc_filedesc(version, name))
                    size = len(parts[0])
                parts.append(arc_record(version, url, block, offset=size, filename=name))
                size += len(parts[-1])
        if parts:
            yield _archive(parts)

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"),
                        F.col(payload_col).cast("string").cast("binary"))
    _write_archives(rows.mapInArrow(run, "content binary"), path)


def read_arc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """``archive, offset, version, url, ip, date, mime, page_id, payload_bytes, payload_digest[, block]``."""
    fields = [pa.field("archive", pa.string()), pa.field("offset", pa.int64()), pa.field("version", pa.int32()),
              pa.field("url", pa.string()), pa.field("ip", pa.string()), pa.field("date", pa.string()),
              pa.field("mime", pa.string()), pa.field("page_id", pa.int64()), pa.field("payload_bytes", pa.int64()),
              pa.field("payload_digest", pa.string())] + [pa.field("block", pa.binary())] * with_block
    schema = ("archive string, `offset` long, version int, url string, ip string, date string, mime string, "
              "page_id long, payload_bytes long, payload_digest string" + ", block binary" * with_block)

    def rows(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for r in parse_arc(_inflate(content)):
                    head, payload = http_parts(r["block"])
                    yield (r["archive"], r["offset"], r["version"], r["url"], r["ip"], r["date"], r["mime"],
                           http_field(head, b"X-Page-Id"), len(payload), sha1_base32(payload),
                           *([r["block"]] * with_block))

    def run(batches):
        yield from _batches(rows(batches), fields, lambda r: len(r[-1]) if with_block else 0)

    return _read_archives(spark, path).mapInArrow(run, schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """Convert the ARC archives below ``arc_path`` to WARC archives below ``warc_path``."""
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", (-F.hash("archive", "offset")).alias("h"),
                    "archive", "offset")
    firsts = (read_arc(spark, arc_path, with_block=False).filter(F.col("payload_bytes") >= min_bytes)
              .groupBy("payload_digest").agg(F.max(rank).alias("top"))
              .select("payload_digest", F.col("top.page_id").alias("to_page"), F.col("top.archive").alias("to_archive"),
                      F.col("top.offset").alias("to_offset")))
    joined = read_arc(spark, arc_path).join(firsts, "payload_digest", "left").select(
        "archive", "offset", "url", "ip", "date", "mime", "payload_digest",
        (F.coalesce((F.col("archive") != F.col("to_archive")) | (F.col("offset") != F.col("to_offset")), F.lit(False))
         & (F.col("payload_bytes") >= min_bytes)).alias("again"), "to_page", "to_archive", "to_offset", "block")

    def run(batches):
        part = TaskContext.get().partitionId()

        number, size, parts = 0, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                record = _converted(*row)
                if parts and size + len(record) > ARCHIVE_BYTES:
                    yield _archive(parts)
                    number, parts = number + 1, []
                if not parts:
                    parts, size = [warc_info(f"pages-{part:06d}-{number:06d}.warc")], 0
                parts.append(record)
                size += len(record)
        if parts:
            yield _archive(parts)

    _write_archives(joined.mapInArrow(run, "content binary"), warc_path)


def _converted(archive, offset, url, ip, date, mime, digest, again, to_page, to_archive, to_offset, block) -> bytes:
    head, _ = http_parts(block)
    fields = [("WARC-Record-ID", f"<{record_urn(archive, offset)}>"), ("WARC-Date", iso_date(date)),
              ("WARC-Target-URI", url), ("WARC-IP-Address", ip), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("Content-Type", "application/http;msgtype=response" if head else mime)]
    if not again:
        return warc_record("response", fields, block)
    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record_urn(to_archive, to_offset)}>")]
    if to_page is not None:
        fields.append(("X-Refers-To-Page-Id", str(to_page)))
    return warc_record("revisit", fields, head)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits: ``record_id, record_type, url, date, page_id, payload_bytes, payload_digest,
    refers_to_record, refers_to, payload``.

    Digest and length of a response are taken from its payload, which must
    agree with the record's own digest; those of a revisit from its fields.
    """
    fields = [pa.field(n, t) for n, t in (
        ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()),
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()))]
    schema = ("record_id string, record_type string, url string, date string, page_id long, payload_bytes long, "
              "payload_digest string, refers_to_record string, refers_to long, payload binary")

    def rows(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for f, block in parse_warc(_inflate(content)):
                    kind = f["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = http_parts(block)
                    digest, length = f["warc-payload-digest"].removeprefix("sha1:"), http_field(head, b"Content-Length")
                    if kind == "response":
                        if sha1_base32(payload) != digest:
                            raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
                        length = len(payload)
                    to_page = f.get("x-refers-to-page-id")
                    yield (f["warc-record-id"].strip("<>"), kind, f.get("warc-target-uri"), f.get("warc-date"),
                           http_field(head, b"X-Page-Id"), length, digest,
                           f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None,
                           int(to_page) if to_page is not None else None,
                           payload if kind == "response" else None)

    def run(batches):
        yield from _batches(rows(batches), fields, lambda r: len(r[-1] or b""))

    return _read_archives(spark, path).mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages to ARC archives, to WARC archives, and back; archives stay in the shared folder."""
    spark = pages.sparkSession
    arc, warc = shared_dir(spark, "llm", "arc"), shared_dir(spark, "llm", "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, min_bytes)
    return read_warc(spark, warc)
