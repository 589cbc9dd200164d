"""Converter from the legacy ARC format to WARC.

ARC volumes start with a version block that names the fields of the header lines to come; version 1
and 2 differ in them.  Lines and declared lengths are parsed, and equivalent WARC records are made:
identifiers from the record's place in its volume, timestamps from the 14 digits, types, and digests of
the payload.  Records with the payload of an earlier one become revisits.  Volumes of both kinds are
files in the shared folder, every record a gzip member of its own; blocks are bytes, in no charset.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import BROADCAST_IDS, scratch, write_table

#: Bytes of records in a volume; a larger record has one of its own.
VOLUME = 8 << 20
#: The header fields that each ARC version names in its version block.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
_END = b"\r\n\r\n"
#: zlib's level: volumes are read back at once.  Bytes that are inflated at a time.
LEVEL, _PIECE = 1, 1 << 14


def _member(data: bytes) -> bytes:
    return zlib.compress(data, LEVEL, 31)


#: A gzip member of no bytes: what follows a volume's records, so that Spark's line separator belongs to the format.
_NOTHING = _member(b"")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _quoted(url: str) -> str:
    """Header lines are split at spaces and line ends."""
    return "".join(f"%{ord(c):02X}" if c in " \t\r\n\x0b\x0c" else c for c in url) or "-"


def arc_head(version: int, name: str) -> bytes:
    block = f"{version} 0 pulsegrid\n{' '.join(ARC_FIELDS[version])}\n".encode()
    middle = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 20260101000000 text/plain {middle}{len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, name: str, at: int, url: str, date: str, block: bytes) -> bytes:
    middle = "" if version == 1 else f"200 {hashlib.md5(block).hexdigest()} - {at} {name} "
    return f"{_quoted(url)} 0.0.0.0 {date} text/html {middle}{len(block)}\n".encode() + block + b"\n"


def parse_arc(content: bytes) -> Iterator[dict]:
    """The records of one volume (gzip or plain) after its version block; keys are the version's field names, ``block`` and ``at``.

    A record cut off by the end of the volume has what is there, and ``short``; a header line that is
    cut off is no record.
    """
    content = _inflated(content)
    names, at = ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"], 0
    while at < len(content):
        if content[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\n", at)
        if end < 0:
            return
        fields = content[at:end].decode("utf-8", "replace").split()
        size = int(fields[-1])
        block = content[end + 1 : end + 1 + size]
        if fields[0].startswith("filedesc://"):
            version = int(block.split(None, 1)[0])
            names = block.split(b"\n")[1].decode().split() or ARC_FIELDS[version]
        else:
            yield dict(zip(names, fields, strict=False)) | {"block": block, "at": at, "short": len(block) < size}
        at = end + 1 + size


def _inflated(content: bytes) -> bytes:
    """All members of a gzip file, one after the other; other bytes as they are."""
    if content[:2] != b"\x1f\x8b":
        return content
    out, at, view = [], 0, memoryview(content)
    while at < len(content):
        part = zlib.decompressobj(31)
        while at < len(content) and not part.eof:
            piece = view[at : at + _PIECE]
            out.append(part.decompress(piece))
            at += len(piece)
        at -= len(part.unused_data)  # of one piece at most
    return b"".join(out)


def write_volumes(volumes: DataFrame, path: str) -> None:
    """A file under ``path`` of each row's ``content``, gzip members, and an empty member.

    Spark's text writer copies the bytes of a string as they are, whatever they mean in UTF-8.
    """
    rows = volumes.select(F.col("content").cast("string").alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", _NOTHING.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files under ``path``."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).select(name.alias("name"), "content")


def _head_and_payload(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    head, mark, payload = block.partition(_END)
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    return fields, head + mark, payload


def arc_volumes(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", volume: int = VOLUME) -> DataFrame:
    """(name, content): ARC volumes of the pages, versions 1 and 2 in turn; a null html is empty, a null url ``-``.

    Content is compressed, a gzip member for each record.  The page's id goes into the stored HTTP head.
    Rows are taken as they lie: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size, version, name = TaskContext.get().partitionId(), 0, [], 0, 1, ""

        def told() -> pa.RecordBatch:
            nonlocal number, size
            number, size, content = number + 1, 0, b"".join(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["name", "content"])

        for batch in batches:
            for key, url, html in zip(*batch.columns, strict=True):
                if not held:
                    version, name = 1 + number % 2, f"part-{part:06}-{number:06}.arc"
                    first = arc_head(version, name)
                    held.append(_member(first))
                    size = len(first)
                payload, page = html.as_py() or b"", key.as_py()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + "\r\n"
                seconds = (page or 0) % 86400
                date = f"20260101{seconds // 3600:02}{seconds // 60 % 60:02}{seconds % 60:02}"
                record = arc_record(version, name, size, (url.as_py() or b"-").decode("utf-8", "replace"), date, head.encode() + payload)
                held.append(_member(record))
                size += len(record)
                if size >= volume:
                    yield told()
        if held:
            yield told()

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("binary"), F.col(html_col).cast("binary")).mapInArrow(run, "name string, content binary")


_RECORD = "origin string, url string, date string, page_id long, digest string, payload_bytes long, head binary, payload binary"


def arc_records(volumes: DataFrame) -> DataFrame:
    """The parsed records of ARC volumes (name, content): origin, url, 14-digit date, page_id, payload digest and size, HTTP head, payload.

    ``origin`` is the volume's name and the record's place in it, which no other record has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                rows, size = [], 0
                for r in parse_arc(content.as_py()):
                    fields, head, payload = _head_and_payload(r["block"])
                    page = fields.get("X-Page-Id")
                    rows.append((f"{name.as_py()}:{r['at']}", r["URL"], r["Archive-date"], int(page) if page else None, sha1_base32(payload), len(payload), head, payload))
                    size += len(payload)
                    if size >= 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _RECORD.split(", ")])

    return volumes.select("name", "content").mapInArrow(run, _RECORD)


def record_id(origin: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, origin)}>"


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_volumes(records: DataFrame, least_bytes: int = 0, volume: int = VOLUME) -> DataFrame:
    """(content): WARC volumes of the records of ``arc_records``, compressed, a gzip member for each record.

    Of equal payloads of ``least_bytes`` or more, the smallest page_id is the response and the others
    are revisits of it; rows that repeat that page_id are responses too.  Records without a page_id come
    last, and are all responses if no record of that payload has one.  Only digests are shuffled: what
    comes back is one row per repeated digest, broadcast after a count, or joined by a shuffle beyond
    ``BROADCAST_IDS`` rows.
    """
    order = F.struct(F.isnull("page_id").alias("none"), "page_id", "origin", "url", "date")
    first = records.where(F.col("payload_bytes") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    repeated = write_table(first.where("n > 1 and not first.none").select("digest", "first"), "repeated")
    few = repeated.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = records.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    marked = marked.select("origin", "url", "date", "page_id", "digest", "payload_bytes", "head", "payload", *(F.col(f"first.{x}").alias(f"f_{x}") for x in ("page_id", "origin", "url", "date")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            nonlocal size
            content, size = b"".join(held), 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                origin, url, date, page, digest, _, head, payload, f_page, f_origin, f_url, f_date = (x.as_py() for x in row)
                revisit = f_page is not None and page != f_page
                block = head if revisit else head + payload
                lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(origin)}", f"WARC-Date: {warc_date(date)}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response"]
                if revisit:
                    lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(f_origin)}", f"WARC-Refers-To-Target-URI: {f_url}", f"WARC-Refers-To-Date: {warc_date(f_date)}", f"X-Refers-To-Page-Id: {f_page}"]
                held.append(_member(b"".join(["\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode(), _END, block, _END])))
                size += len(block)
                if size >= volume:
                    yield told()
        if held:
            yield told()

    return marked.mapInArrow(run, "content binary")


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record, by declared length."""
    content, at = _inflated(content), 0
    while at < len(content):
        end = content.index(_END, at)
        fields = dict(x.split(": ", 1) for x in content[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        size = int(fields["Content-Length"])
        yield fields, content[end + 4 : end + 4 + size]
        at = end + 8 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records under ``path``.

    Digests of blocks are computed again; one that differs from its record raises ValueError.
    """
    names = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_warc(content.as_py()):
                    if f"sha1:{sha1_base32(block)}" != fields["WARC-Block-Digest"]:
                        raise ValueError(f"{fields['WARC-Record-ID']}: its block has another digest")
                    http, _, _ = _head_and_payload(block)
                    page, first = http.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], int(first) if first else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in names.split(", ")])

    return read_volumes(spark, path).select("content").mapInArrow(run, names)


def convert_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages to ARC volumes in the shared folder, these to WARC volumes beside them, and what is read back from the latter.

    An empty table gives no rows; repeated rows give a record each.
    """
    spark = pages.sparkSession
    arcs, warcs = scratch(spark, "arc"), scratch(spark, "warc")
    write_volumes(arc_volumes(pages), arcs)
    write_volumes(warc_volumes(arc_records(read_volumes(spark, arcs)), least_bytes), warcs)
    return read_warc(spark, warcs)


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), named AS (
  SELECT page_id, payload_bytes, hex,
    {" || ".join(f"substr('{_DIGITS}', ((('0x' || substr(hex, {5 * i + 1}, 5))::INTEGER >> {15 - 5 * j}) & 31) + 1, 1)" for i in range(8) for j in range(4))} AS payload_digest
  FROM hashed
), firsts AS (SELECT hex, min(page_id) AS first FROM hashed GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM named JOIN firsts USING (hex)
"""
