"""Legacy web archives: writing ARC, converting ARC to WARC, and reading both back.

ARC files start with a version block whose declared version says which header line follows: version 1 records have
``URL IP date type length``, version 2 records also ``status checksum location offset filename``. The converter parses
the line of the file's own version, takes the declared number of bytes, and synthesises WARC/1.1 records: a warcinfo per
file, then a response or revisit per record with a name-based UUID of the record's place and content, a timestamp from
the 14-digit date, and base32 SHA-1 digests of block and payload.

Payloads that are equal and at least SHORTEST bytes long become one response, that with the smallest page_id, and
revisits of it. That needs two passes over the ARC files: the first gives digests, from which Spark finds each digest's
smallest page_id (partial aggregation, then a join that adaptive execution can split); the second writes each WARC file
next to its decisions, which come as rows of the file's own. Archives are one gzip member per record, rotated at
FILE_BYTES of input; a file is written under a name of its own attempt and counts only if its name comes back as a row,
so lost executors and second attempts leave no double records.

The operator's own files go to and come from the cluster's shared folder through pyarrow's file systems, named by
written rows; archives of others are read through Spark's binary source (``read_binary``).

Defined results: null html is an empty payload; null and empty urls are written as ``-`` in ARC and come back as null;
white space and control characters of a url come back percent-encoded, as an ARC line needs them; a null page_id comes back as null and is never referred to before others; repeated rows are records of their own (of equal
payloads with the same smallest page_id one is the response); empty tables give empty archives and results.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import scratch

SHORTEST = 0
FILE_BYTES = 8 << 20
TASK_BYTES = 512 << 20
LEVEL = 1
#: Bytes given to a decompressor at once, so that what follows a member is not copied again and again.
FED = 1 << 14
DATE = "20240101000000"
NAMESPACE = uuid.UUID("7b0c4a52-61d7-5c1e-9d5a-3f1f2f6d9a10")

ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(blob: bytes) -> Iterator[bytes]:
    """The contents of a file's gzip members in order; a file that isn't compressed is one."""
    if not blob.startswith(b"\x1f\x8b"):
        yield blob
        return
    view, at = memoryview(blob), 0
    while at < len(blob):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if at >= len(blob):
                raise ValueError("the last gzip member is cut short")
            parts.append(unpacker.decompress(view[at : at + FED]))
            at = min(at + FED, len(blob)) - len(unpacker.unused_data)
        yield b"".join(parts)


def shared_file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def store(path: str, data: bytes) -> None:
    system, place = shared_file_system(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place, compression=None) as out:
        out.write(data)


def load(path: str) -> bytes:
    system, place = shared_file_system(path)
    with system.open_input_stream(place, compression=None) as source:
        return source.read()


# ---------------------------------------------------------------- ARC


def arc_start(version: int, name: str) -> bytes:
    fields = " ".join(ARC_FIELDS[version])
    body = f"{version} 0 riskloom\n{fields}\n".encode()
    rest = ["0.0.0.0", DATE, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else []) + [str(len(body))]
    return f"filedesc://{name} {' '.join(rest)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str | None, block: bytes, name: str, offset: int) -> bytes:
    place = re.sub("[\\x00-\\x20\\x7f]", lambda c: f"%{ord(c[0]):02X}", url or "") or "-"
    rest = ["0.0.0.0", DATE, "text/html"] + (["200", sha1_32(block), "-", str(offset), name] if version == 2 else []) + [str(len(block))]
    return f"{place} {' '.join(rest)}\n".encode() + block + b"\n"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(header bytes, fields, payload); a block without HTTP header is all payload."""
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    if end < 0:
        return b"", {}, block
    fields = dict(x.split(": ", 1) for x in block[:end].decode("latin-1").split("\r\n")[1:] if ": " in x)
    return block[: end + 4], {k.lower(): v for k, v in fields.items()}, block[end + 4 :]


def parse_arc(blob: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(number, header fields, block) of each record after the version block."""
    fields: list[str] = []
    number = 0
    for part in members(blob):
        at = 0
        while at < len(part):
            if part[at : at + 1] in b"\r\n":
                at += 1
                continue
            end = part.index(b"\n", at)
            values = part[at:end].decode("utf-8").rstrip("\r").split(" ")
            size = int(values[-1])
            block = part[end + 1 : end + 1 + size]
            if len(block) != size:
                raise ValueError(f"record {number} declares {size} bytes and has {len(block)}")
            at = end + 1 + size
            if not fields:
                if not values[0].startswith("filedesc://"):
                    raise ValueError("an ARC file starts with its version block")
                fields = ARC_FIELDS[int(block.split(b" ", 1)[0])]
                continue
            if len(values) != len(fields):
                raise ValueError(f"record {number} has {len(values)} fields; its version has {len(fields)}")
            yield number, dict(zip(fields, values)), block
            number += 1


def write_arc(pages: DataFrame, folder: str, version: int = 1) -> DataFrame:
    """Write (page_id, url, html) rows as ARC files; the rows (path, records) of the files written."""

    def run(batches):
        file = _Rotating(folder, "arc.gz", lambda name: arc_start(version, name))
        for batch in batches:
            for page, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                block = http_block(page.as_py(), (html.as_py() or "").encode())
                yield from file.add(lambda name, at, u=url.as_py(), b=block: arc_record(version, u, b, name, at))
        yield from file.close()

    return scratch.stage(pages.select("page_id", "url", "html").mapInArrow(run, "path string, records long"), "arc-files")


class _Rotating:
    """Files of one task attempt, closed at FILE_BYTES; closing one gives its row."""

    def __init__(self, folder: str, ending: str, start):
        task = TaskContext.get()
        self.base = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        self.ending, self.start, self.number = ending, start, 0
        self._open()

    def _open(self) -> None:
        self.path = f"{self.base}-{self.number:05d}.{self.ending}"
        self.out, self.records, self.taken = io.BytesIO(), 0, 0
        self.out.write(member(self.start(self.path.rsplit("/", 1)[1])))

    def add(self, record):
        data = record(self.path.rsplit("/", 1)[1], self.out.tell())
        self.out.write(member(data))
        self.records += 1
        self.taken += len(data)
        if self.taken >= FILE_BYTES:
            yield from self.close()
            self.number += 1
            self._open()

    def close(self):
        if self.records:
            store(self.path, self.out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([self.records], pa.int64())], ["path", "records"])
            self.records = 0


# ---------------------------------------------------------------- WARC


def warc_date(date14: str) -> str:
    d = date14.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def convert(fields: dict[str, str], block: bytes, place: str, first: int | None, revisit: bool) -> bytes:
    """The WARC record that says what an ARC record says; ``first`` is the page of the response that a revisit repeats."""
    head, http, payload = split_http(block)
    digest = sha1_32(payload)
    body = head if revisit else block
    out = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{place} {fields['URL']} {digest}')}>"),
        ("WARC-Date", warc_date(fields["Archive-date"])),
        ("WARC-Target-URI", fields["URL"]),
        ("WARC-IP-Address", fields["IP-address"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_32(body)}"),
        ("Content-Type", "application/http;msgtype=response" if head else fields["Content-type"]),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        out.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if first is not None:
            out.append(("X-Refers-To-Page", str(first)))
    return warc_record(out, body)


def parse_warc(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record."""
    for part in members(blob):
        at = 0
        while (at := part.find(b"WARC/", at)) >= 0:
            end = part.index(b"\r\n\r\n", at)
            fields = dict(x.split(": ", 1) for x in part[at:end].decode("utf-8").split("\r\n")[1:])
            fields = {k.lower(): v for k, v in fields.items()}
            size = int(fields["content-length"])
            yield fields, part[end + 4 : end + 4 + size]
            at = end + 4 + size


def read_binary(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content) of archive files, from any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")


def open_files(files: DataFrame) -> DataFrame:
    """(path, content) of the files in the shared folder that ``files`` names; left-overs of failed attempts stay unread."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([load(path)], pa.binary())], ["path", "content"])

    return spread(files.select("path")).mapInArrow(run, "path string, content binary")


def spread(files: DataFrame) -> DataFrame:
    """Rows of files, each of about FILE_BYTES, over tasks of about TASK_BYTES (over all cores at least); the number is its
    own, which adaptive execution leaves alone. A task goes through its files one by one."""
    n = files.count()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism * 4, -(-n * FILE_BYTES // TASK_BYTES))
    return files.repartition(max(1, min(n, tasks)), "path")


def arc_digests(files: DataFrame) -> DataFrame:
    """(path, number, page_id, digest, size) of each record of (path) rows of ARC files in the shared folder.

    ``digest`` is the SHA-1 and the SHA-256 of the payload together: equal payloads are those equal in both and in size.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for number, _, block in parse_arc(load(path)):
                    _, http, payload = split_http(block)
                    page = http.get("x-page-id")
                    rows.append((path, number, None if page is None else int(page), hashlib.sha1(payload).digest() + hashlib.sha256(payload).digest(), len(payload)))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "number", "page_id", "digest", "size"])

    return spread(files.select("path")).mapInArrow(run, "path string, number long, page_id long, digest binary, size long")


def decide(records: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(path, revisits): record numbers of each file that revisit, with the page they refer to."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "number")
    firsts = (
        records.where(F.col("size") >= shortest).groupBy("digest", "size").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    firsts = scratch.stage(firsts.select("digest", "size", "first"), "warc-firsts")
    again = records.join(firsts.hint("merge"), ["digest", "size"]).where(~((F.col("path") == F.col("first.path")) & (F.col("number") == F.col("first.number"))))
    return again.groupBy("path").agg(F.collect_list(F.struct("number", F.col("first.page_id").alias("page"))).alias("revisits"))


def convert_files(files: DataFrame, folder: str, shortest: int = SHORTEST) -> DataFrame:
    """Convert the ARC files that ``files`` names into WARC files; rows (path, records) of those."""
    records = scratch.stage(arc_digests(files), "arc-digests")
    planned = spread(files.select("path").join(decide(records, shortest), "path", "left"))

    def run(batches):
        for batch in batches:
            for path, revisits in zip(batch.column("path").to_pylist(), batch.column("revisits").to_pylist()):
                again = {r["number"]: r["page"] for r in revisits or []}
                name = path.rsplit("/", 1)[1]
                info = lambda own, name=name: warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, own)}>"), ("WARC-Date", warc_date(DATE)), ("WARC-Filename", own), ("Content-Type", "application/warc-fields")], f"software: riskloom\r\nconformsTo: WARC/1.1\r\nsource: {name}\r\n".encode())
                file = _Rotating(folder, "warc.gz", info)
                for number, fields, block in parse_arc(load(path)):
                    data = convert(fields, block, f"{name} {number}", again.get(number), number in again)
                    yield from file.add(lambda _, at, d=data: d)
                yield from file.close()

    return scratch.stage(planned.mapInArrow(run, "path string, records long"), "warc-files")


def read_warc(files: DataFrame) -> DataFrame:
    """One row per response or revisit record of (path, content) rows; ``payload`` is null for revisits."""

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "payload"]
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in parse_warc(content.as_py()):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    _, http, payload = split_http(block)
                    fresh = fields["warc-type"] == "response"
                    size = len(payload) if fresh else int(fields["x-payload-length"])
                    digest = sha1_32(payload) if fresh else fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-payload-digest"] != f"sha1:{digest}":
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
                    page, first = http.get("x-page-id"), fields.get("x-refers-to-page")
                    uri = fields["warc-target-uri"]
                    rows.append((page and int(page), None if uri == "-" else uri, size, digest, fields["warc-type"], first and int(first), fields["warc-record-id"], fields["warc-date"], payload if fresh else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, payload binary")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC files, converted to WARC files, read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    arcs = write_arc(pages, scratch.folder(spark, "arc"))
    warcs = convert_files(arcs, scratch.folder(spark, "warc"))
    return read_warc(open_files(warcs)).select(*columns)


#: Digests and first pages straight from the pages; five hex digits are four of base 32.
OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INTEGER) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""
