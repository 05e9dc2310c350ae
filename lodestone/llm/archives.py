"""Operator 8: web archives. Legacy ARC records are parsed and converted to WARC records; archives are written and read back.

An ARC file begins with a version block that names the fields of its URL lines (version 1: URL, IP, date, type, length;
version 2 adds result code, checksum, location, offset and file name). Each record is a URL line and a body of the
declared length. The converter makes what WARC needs and ARC lacks: record identifiers (a UUID from the record's own
contents, so that a task that runs anew writes the same), ISO timestamps, record types, and payload and block digests.

Equal payloads of some size are stored once: all records but the one with the smallest key become revisits, which keep
the HTTP head, the payload's digest and a reference, and no payload.

Contract: a null html counts as empty; a null url is written as `urn:page:<key>`; a null key is written as an empty
identifier, never refers and is never referred to; repeated keys are separate records, and rows that repeat the smallest
key of a payload with it are all responses; an empty table gives no files and no rows; other columns don't matter; a long
page is one record. Damage (wrong lengths, digests or heads) raises ValueError on reading.

Files are bounded by bytes and by records, and begin with a warcinfo record. Every record has digests of its block and its
payload; a revisit names the record and the URL of the response that it repeats.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.store import cut, new_folder

CAPTURED, IP = "20240101000000", "0.0.0.0"
LEAST_SHARED = 100
#: Uncompressed bytes and records of an archive file, bytes that count for each record's heads, and rows of repeated payloads that may be broadcast.
FILE_BYTES, FILE_RECORDS, HEAD_BYTES, BROADCAST_ROWS = 16 << 20, 4000, 1024, 200_000
#: Compressed bytes that are unpacked at a time.
UNPACKED = 1 << 16
_V1 = b"URL IP-address Archive-date Content-type Archive-length"
_V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"


def arc_file(name: str, version: int, records: list[tuple[str, str, bytes]]) -> bytes:
    """An ARC file of (URL, content type, body) records: what old crawlers left."""
    fields = _V1 if version == 1 else _V2
    head = f"{version} 0 lodestone\n".encode() + fields + b"\n"
    out = bytearray(f"filedesc://{name} {IP} {CAPTURED} text/plain ".encode() + (b"" if version == 1 else b"200 - - 0 " + name.encode() + b" ") + str(len(head)).encode() + b"\n" + head)
    for url, kind, body in records:
        middle = "" if version == 1 else f" 200 {zlib.crc32(body):08x} - {len(out) + 1} {name}"
        out += f"\n{url} {IP} {CAPTURED} {kind}{middle} {len(body)}\n".encode() + body
    return bytes(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(URL-line fields, body) of every record after the version block."""

    def line(at: int) -> tuple[str, int]:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an unfinished URL line")
        return data[at:end].decode(), end + 1

    text, at = line(0)
    if not text.startswith("filedesc://"):
        raise ValueError("no version block")
    size = int(text.rsplit(" ", 1)[1])
    block = data[at : at + size].decode().split("\n")
    version, names = int(block[0].split(" ")[0]), block[1].split(" ")
    if len(names) != {1: 5, 2: 10}.get(version):
        raise ValueError("an unknown version")
    at += size
    while at < len(data):
        if data[at : at + 1] != b"\n":
            raise ValueError("a record's length is wrong")
        text, at = line(at + 1)
        values = text.rsplit(" ", len(names) - 1)  # a URL may hold spaces
        if len(values) != len(names) or not values[-1].isdigit() or at + int(values[-1]) > len(data):
            raise ValueError("a damaged URL line")
        fields = dict(zip(names, values, strict=True))
        body = data[at : at + int(values[-1])]
        if version == 2 and fields["Checksum"] != f"{zlib.crc32(body):08x}":
            raise ValueError("a record's checksum is wrong")
        yield fields, body
        at += len(body)


def _date(archived: str) -> str:
    return datetime.strptime(archived, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _record_id(*parts: str) -> str:
    """An identifier from what a record is, so that others can name it without having seen it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(' '.join(parts).encode()).digest()[:16], version=5)}>"


def _uri(url: str | None, key: object) -> str:
    return (url or f"urn:page:{key if key is not None else ''}").replace("\n", "%0A").replace("\r", "%0D")


def _record(head: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo_record(name: str) -> bytes:
    """What an archive file begins with."""
    block = f"software: lodestone\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
    date = _date(CAPTURED)
    return _record(["WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id('warcinfo', name)}", f"WARC-Date: {date}", f"WARC-Filename: {name}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/warc-fields"], block)


def warc_record(fields: dict[str, str], body: bytes, key: str, refers_to: str | None, refers_url: str | None = None) -> bytes:
    """A WARC record of an ARC record whose body is an HTTP message; with refers_to, a revisit of the payload of that key's response, whose URL is refers_url."""
    cut_at = body.find(b"\r\n\r\n") + 4
    if cut_at < 4:
        raise ValueError("no HTTP head")
    digest = hashlib.sha256(memoryview(body)[cut_at:]).hexdigest()
    block = body[:cut_at] if refers_to is not None else body
    date, url = _date(fields["Archive-date"]), fields["URL"]
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(url, date, kind, key, digest)}", f"WARC-Target-URI: {url}", f"WARC-Date: {date}", f"WARC-IP-Address: {fields['IP-address']}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        target = _uri(refers_url, refers_to)
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(target, date, 'response', refers_to, digest)}", f"WARC-Refers-To-Target-URI: {target}", f"X-Refers-To-Page: {refers_to}"]
    return _record([*head, f"X-Page: {key}", "Content-Type: application/http;msgtype=response"], block)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head fields, block) of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError("no record head")
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        stop = end + 4 + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        yield fields, data[end + 4 : stop]
        at = stop + 4


def _packed(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _convert(rows: list[tuple[int | None, str | None, bytes, int | None, str | None]], name: str, version: int) -> bytes:
    """Pages as an ARC file, parsed and converted record by record into a compressed WARC file, one member for each record."""
    bodies = []
    for key, url, payload, _, _ in rows:
        kind = "text/html"
        bodies.append((_uri(url, key), kind, f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload))
    out = [_packed(warcinfo_record(name.removesuffix(".arc") + ".warc.gz"))]
    for (fields, body), (key, _, _, refers_to, refers_url) in zip(parse_arc(arc_file(name, version, bodies)), rows, strict=True):
        out.append(_packed(warc_record(fields, body, "" if key is None else str(key), None if refers_to is None else str(refers_to), refers_url)))
    return b"".join(out)


def _store(folder: str):
    """(file system, path) of a URI; stores that Spark knows by Hadoop's names have others there."""
    from pyarrow import fs

    scheme, mark, rest = folder.partition(":")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}.get(scheme, scheme) + mark + rest)


def shared_digest(html: str) -> Column:
    """The digest of a payload that is large enough to be stored once, else null."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return F.when(F.length(payload) >= LEAST_SHARED, F.sha2(payload, 256))


def revisits(pages: DataFrame, key: str, html: str, url: str = "url") -> DataFrame:
    """(key, digest, refers_to, refers_url) of pages that repeat an earlier page's payload: counted by digest with partial sums, so that no group of copies is gathered. Of equal smallest keys the smallest URL counts."""
    marked = pages.select(key, F.col(url).alias("_url"), shared_digest(html).alias("digest")).where(F.col(key).isNotNull() & F.col("digest").isNotNull())
    first = marked.groupBy("digest").agg(F.min(F.struct(F.col(key).alias("k"), F.col("_url").alias("u"))).alias("f"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("f.k").alias("refers_to"), F.col("f.u").alias("refers_url"))
    return marked.join(first, "digest").where(F.col(key) != F.col("refers_to")).select(key, "digest", "refers_to", "refers_url").distinct()


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", version: int | None = None) -> DataFrame:
    """Writes the pages as WARC files into the folder (a URI that all executors reach) and returns (file, records, bytes), lazily: an action on the result does the work.

    The legacy archives that they come from are of the given version; by default half of them, by a hash of their contents,
    are of version 1, and half of version 2. File names come from the contents, the task's number and its files' order, so that equal pages of several files don't meet in one, and a task that runs twice writes the same
    file, whole, under the same name; their first two figures name one of 256 subfolders.
    """
    again = cut(revisits(pages, key, html, url))
    small = F.broadcast(again) if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else again
    joined = pages.select(key, url, html, shared_digest(html).alias("digest")).join(small, [key, "digest"], "left").select(key, url, F.coalesce(F.col(html), F.lit("")).cast("binary"), "refers_to", "refers_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)

        task = TaskContext.get().partitionId()
        made = count()

        def flush(rows: list) -> pa.RecordBatch:
            mark = hashlib.sha256(repr([task, next(made), *((r[0], r[1], len(r[2])) for r in rows)]).encode()).hexdigest()[:24]
            data = _convert(rows, f"{mark}.arc", version or 1 + int(mark, 16) % 2)
            name = f"{mark[:2]}/{mark}-{hashlib.sha256(data).hexdigest()[:8]}.warc.gz"
            store.create_dir(f"{path}/{mark[:2]}", recursive=True)
            temp = f"{path}/{mark[:2]}/_{uuid.uuid4().hex}"
            with store.open_output_stream(temp) as file:
                file.write(data)
            store.move(temp, f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([len(data)], pa.int64())], names=["file", "records", "bytes"])

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[2]) + HEAD_BYTES
                if size >= FILE_BYTES or len(rows) >= FILE_RECORDS:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    return joined.mapInArrow(run, "file string, records long, bytes long")


def members(content: bytes) -> Iterator[bytes]:
    """Unpacked members of a compressed archive, one after the other; what is packed is gone through once, in blocks."""
    view, at = memoryview(content), 0
    while at < len(view):
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            block = view[at : at + UNPACKED]
            if not block:
                raise ValueError("the last member is cut off")
            out.append(member.decompress(block))
            at += len(block)
        at -= len(member.unused_data)
        yield b"".join(out)


def _records(content: bytes) -> pa.RecordBatch:
    """The records of one archive, verified."""
    rows = []
    for data in members(content):
        for fields, block in parse_warc(data):
            if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
                raise ValueError("a block's digest is wrong")
            if fields["WARC-Type"] == "warcinfo":
                continue
            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            head, _, payload = block.partition(b"\r\n\r\n")
            size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            revisit = fields["WARC-Type"] == "revisit"
            if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError("a payload's digest is wrong")
            refers = fields.get("X-Refers-To-Page", "")
            rows.append((int(fields["X-Page"]) if fields["X-Page"] else None, size, digest, fields["WARC-Type"], int(refers) if refers else None))
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_back(spark: SparkSession, folder: str, key: str = "page_id", files: DataFrame | None = None) -> DataFrame:
    """One row per record of the archives in the folder: key, payload_bytes, payload_digest, record_type, refers_to. Digests of stored payloads and blocks are verified.

    files (file) names the archives to read, as paths under the folder: nothing is listed then, and others, that lost
    tasks may have left, are passed over.
    """
    schema = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield _records(content.as_py())

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for name in batch.column(0):
                with store.open_input_stream(f"{path}/{name.as_py()}", compression=None) as file:
                    yield _records(file.read())

    if files is not None:
        own = files.select("file").mapInArrow(fetch, schema)
    else:
        own = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select("content").mapInArrow(run, schema)
    return own.withColumnRenamed("key", key)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes archives into the cluster's shared folder and reads them back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    written = cut(write(pages, folder, key, url, html))
    if written.isEmpty():
        return spark.createDataFrame([], T._parse_datatype_string(f"`{key}` long, payload_bytes long, payload_digest string, record_type string, refers_to long"))
    return read_back(spark, folder, key, written)
