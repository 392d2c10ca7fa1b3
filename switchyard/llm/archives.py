"""Web archives: ARC files written, converted to WARC with revisits, and WARC files read.

Method: a legacy converter.  An ARC file begins with a version block whose second line names the fields of its header lines
(five in version 1, ten in version 2); a record is such a line and as many bytes as it declares.  From these the converter
makes WARC identifiers (a name-based UUID of file, offset, address and time), timestamps, record types and SHA-1 digests.

Scale: files are written by Spark's text writer, one for each partition, with the records' closing line breaks as its line
separator, and read by its binary source, so any store that Spark reaches will do; an archive is decompressed as a stream.  Which
record of equal payloads is kept is settled on digests alone; payloads are shuffled once, to meet that decision.  Groups
that hold over a 10,000th of the rows, of which there can be but 10,000, are broadcast; the others are joined.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator, Sequence
from typing import IO, Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm.scratch import fresh, root, stored, tracked
from switchyard.llm.text import sliced

# Fixed names of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ARC = "path string, offset long, version int, uri binary, ip string, date string, mime string, head binary, body binary, n long, digest binary, page_id long, record_id string, http boolean"
_WARC = "record_id string, type string, uri string, date string, payload_bytes long, payload_digest string, refers_id string, page_id long, intact boolean"
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in text.split(", ")])


def _batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``size`` bytes from (bytes, row)."""
    held, out = 0, []
    for n, row in rows:
        out.append(row)
        held += n + 200
        if held > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            held, out = 0, []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def _opened(content: bytes) -> IO[bytes]:
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _save(values: DataFrame, path: str, separator: str) -> None:
    """One compressed file for each partition; its rows are followed by ``separator``."""
    values.select(F.col("value").cast("string").alias("value")).write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """(head with its empty line, body) of an HTTP response; the head is empty where the block is none."""
    end = re.search(rb"\r?\n\r?\n", block) if block.startswith(b"HTTP/") else None
    return (block[: end.end()], block[end.end() :]) if end else (b"", block)


def http_field(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head)
    return found[1].strip() if found else None


def _number(value: bytes | None) -> int | None:
    return int(value) if value and re.fullmatch(rb"-?\d{1,18}", value) else None


def arc_records(stream: IO[bytes]) -> Iterator[tuple[int, int, dict[str, bytes], bytes]]:
    """(offset, version, fields by lower-case name, block) of each record after the version block.

    Without a version block, the number of a line's fields tells the version.  Addresses may hold spaces: fields are
    counted from the end.  A file that ends within a record is an error.
    """
    names, version, at = None, 0, 0
    while line := stream.readline():
        offset, at = at, at + len(line)
        if not line.strip():
            continue  # between records
        length = int(line.rsplit(b" ", 1)[1])
        block = stream.read(length)
        at += len(block)
        if len(block) < length:
            raise ValueError(f"the archive ends within the record at {offset}")
        if line.startswith(b"filedesc://"):
            first, second = block.split(b"\n")[:2]
            version, names = int(first.split()[0]), second.decode().lower().split()
            continue
        if names is None:
            version = 2 if line.count(b" ") >= 9 else 1
        known = names or ARC_FIELDS[version].lower().split()
        yield offset, version, dict(zip(known, line.rstrip(b"\r\n").rsplit(b" ", len(known) - 1), strict=True)), block


def write_arc(pages: DataFrame, path: str, versions: Sequence[int] = (1, 2), date: str = "20000101000000") -> None:
    """``pages`` (page_id, url, html, ...) as ARC files, whose versions take turns.

    A page is an HTTP response that holds its id in a field ``X-Page-Id`` (left out where null).  Null html is empty.  A null url is
    ``unknown:``; blanks and controls in a url are escaped.  The tables have no time of capture: ``date`` is that of all.
    """

    def record(version: int, uri: bytes, mime: str, block: bytes, offset: int, name: str) -> bytes:
        more = b"" if version == 1 else f" 200 {hashlib.sha1(block).hexdigest()} - {offset} {name}".encode()
        return uri + f" 0.0.0.0 {date} {mime}".encode() + more + f" {len(block)}\n".encode() + block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = versions[part % len(versions)], f"pages-{part}.arc"

        def rows() -> Iterator[tuple[int, tuple]]:
            block = f"{version} 0 switchyard\n{ARC_FIELDS[version]}\n\n".encode()
            value = record(version, f"filedesc://{name}".encode(), "text/plain", block, 0, name)
            yield len(value), (value,)
            at = len(value) + 1
            for batch in sliced(batches, 2):
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    body = html or b""
                    own = "" if page is None else f"X-Page-Id: {page}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{own}\r\n".encode()
                    uri = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url or b"unknown:")
                    value = record(version, uri, "text/html", head + body, at, name)
                    at += len(value) + 1
                    yield len(value), (value,)

        yield from _batches(rows(), _schema("value binary"))

    columns = [F.col("page_id").cast("long").alias("page_id"), *(F.col(c).cast("string").cast("binary").alias(c) for c in ("url", "html"))]
    _save(pages.select(*columns).mapInArrow(run, "value binary"), path, "\n")


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of ARC files: path, offset, version, uri, ip, date (14 digits), mime, head, body, n and digest (of the body), page_id, record_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for offset, version, fields, block in arc_records(_opened(content.as_buffer().to_pybytes())):
                        head, body = http_parts(block)
                        uri, date = fields["url"], fields["archive-date"].decode()
                        identity = hashlib.sha1(b" ".join([name.encode(), str(offset).encode(), uri, date.encode()])).digest()
                        row = (name, offset, version, uri, fields["ip-address"].decode(), date, fields["content-type"].decode(), head if payloads else None, body if payloads else None)
                        yield payloads * len(block), (*row, len(body), hashlib.sha1(body).digest(), _number(http_field(head, b"x-page-id")), str(uuid.UUID(bytes=identity[:16], version=5)), bool(head))

        yield from _batches(rows(), _schema(_ARC))

    return _files(spark, path).mapInArrow(run, _ARC)


def timestamp(digits: str) -> str:
    """An ISO time of an ARC date; dates of fewer than 14 digits are filled up with their first month, day or zeros."""
    full = (digits + "00000101000000"[len(digits) :])[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:]}Z"


def looked_up(rows: DataFrame, table: DataFrame, key: Sequence[str], hot: int = 10_000) -> DataFrame:
    """``rows`` joined to ``table`` (one row a key).  Keys of over a ``hot``-th of the rows are broadcast, so that no task gets them whole."""
    total = rows.count()
    heavy = F.broadcast(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * hot > F.lit(total)).select(*key))
    few = F.broadcast(table.join(heavy, list(key), "left_semi"))
    return rows.join(few, list(key)).unionByName(rows.join(heavy, list(key), "left_anti").join(table, list(key)))


def revisits(keys: DataFrame, least: int = 0) -> DataFrame:
    """path, offset, and refers_id, refers_uri, refers_date of the record kept: that of the smallest page_id (null last), then by place."""
    able = keys.where((F.col("n") >= least) & F.col("http"))
    order = F.struct(F.col("page_id").isNull().alias("bare"), "page_id", "path", "offset", F.col("record_id").alias("refers_id"), F.col("uri").alias("refers_uri"), F.col("date").alias("refers_date"))
    kept = stored(able.groupBy("digest", "n").agg(F.min(order).alias("kept"), F.count(F.lit(1)).alias("members")).where("members > 1").select("digest", "n", "kept"), "kept")
    found = looked_up(able.select("digest", "n", "path", "offset"), kept, ["digest", "n"])
    return found.where((F.col("path") != F.col("kept.path")) | (F.col("offset") != F.col("kept.offset"))).select("path", "offset", "kept.refers_id", "kept.refers_uri", "kept.refers_date")


def convert(spark: SparkSession, arc: str, warc: str, least: int = 0) -> None:
    """ARC files as WARC files.  Of responses with equal payloads of ``least`` bytes or more one stays, the others become revisits.

    Blocks that are HTTP responses become ``response`` records, all others ``resource``; every file begins with a ``warcinfo``.
    """
    keys = stored(read_arc(spark, arc, payloads=False).select("path", "offset", "uri", "date", "n", "digest", "page_id", "record_id", "http"), "keys")
    again = stored(revisits(keys, least), "revisits")

    def record(fields: Sequence[tuple[str, Any]], block: bytes) -> bytes:
        lines = [b"WARC/1.1"]
        for name, value in (*fields, ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"), ("Content-Length", len(block))):
            lines.append(name.encode() + b": " + (value if isinstance(value, bytes) else str(value).encode()))
        return b"\r\n".join(lines) + b"\r\n\r\n" + block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple[int, tuple]]:
            info = b"software: switchyard\r\nformat: WARC File Format 1.1\r\n"
            own = uuid.uuid5(uuid.NAMESPACE_URL, f"{warc}/{part}")
            yield len(info), (record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", timestamp("")), ("Content-Type", "application/warc-fields")], info),)
            for batch in sliced(batches, 5):
                for uri, ip, date, mime, head, body, digest, key, to_id, to_uri, to_date in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    kind = "revisit" if to_id else "response" if head else "resource"
                    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{key}>"), ("WARC-Date", timestamp(date)), ("WARC-Target-URI", uri), ("WARC-IP-Address", ip)]
                    fields += [("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"), ("Content-Type", "application/http; msgtype=response" if head else mime)]
                    if to_id:
                        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{to_id}>"), ("WARC-Refers-To-Target-URI", to_uri), ("WARC-Refers-To-Date", timestamp(to_date))]
                    value = record(fields, head if to_id else head + body)
                    yield len(value), (value,)

        yield from _batches(rows(), _schema("value binary"))

    every = read_arc(spark, arc).join(again.hint("shuffle_hash"), ["path", "offset"], "left")
    _save(every.select("uri", "ip", "date", "mime", "head", "body", "digest", "record_id", "refers_id", "refers_uri", "refers_date").mapInArrow(run, "value binary"), warc, "\r\n\r\n")


def warc_records(stream: IO[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(fields by lower-case name, block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields[b"content-length"]))
        if len(block) < int(fields[b"content-length"]):
            raise ValueError("the archive ends within a record")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files but warcinfo: record_id, type, uri, date, payload_bytes, payload_digest (both of the full payload), refers_id, page_id, intact.

    A revisit has no payload: its digest is the declared one, its bytes those of the HTTP head.  ``intact`` tells that block and
    payload agree with the declared digests.
    """

    def plain(value: bytes | None) -> str | None:
        return value.decode().strip("<>").removeprefix("urn:uuid:") if value else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()

        def rows() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for content in batch.column(1):
                    for fields, block in warc_records(_opened(content.as_buffer().to_pybytes())):
                        kind = fields[b"warc-type"].decode()
                        if kind == "warcinfo":
                            continue
                        head, body = http_parts(block)
                        declared = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
                        intact = fields[b"warc-block-digest"].decode() == f"sha1:{digest(block)}" and (kind == "revisit" or declared == digest(body))
                        n = _number(http_field(head, b"content-length")) if kind == "revisit" else len(body)
                        yield 0, (plain(fields[b"warc-record-id"]), kind, fields[b"warc-target-uri"].decode(errors="replace"), fields[b"warc-date"].decode(), n, declared, plain(fields.get(b"warc-refers-to")), _number(http_field(head, b"x-page-id")), intact)

        yield from _batches(rows(), _schema(_WARC))

    return _files(spark, path).mapInArrow(run, _WARC)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html, ...) through ARC and WARC files and back: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    One row for each input row.  Null html is the empty payload, and empty payloads are equal.  Of repeated rows one is the
    response; a page without id is one only if all of its group are.  Other columns are ignored.  Empty input gives no rows.
    """
    spark = pages.sparkSession
    arc, warc = (tracked(f"{root(spark)}/switchyard-{fresh()}-{kind}") for kind in ("arc", "warc"))
    write_arc(pages, arc)
    convert(spark, arc, warc, least)
    records = stored(read_warc(spark, warc), "records")
    kept = records.where("type <> 'revisit'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "intact"]
    again = looked_up(records.where("type = 'revisit'"), kept, ["refers_id"]).select(*columns)
    return records.where("type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(again)
