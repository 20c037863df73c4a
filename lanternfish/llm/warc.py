"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own.  A task writes one archive under a temporary name and renames it, so a
repeated task replaces its own file.  The reader cuts files into byte ranges: a task scans its range for the gzip
magic, takes a candidate for a member if what it decodes to begins with a WARC version line and a header, and from
there on follows members one after the other; it owns the records whose first byte lies in its range, and reads
the last of them beyond the end.  A range within one long record owns nothing.  Nobody needs an index.

Files are reached through Arrow's file systems by the URI of the folder (file, hdfs, s3, gs), which driver and
executors must share.

Defined results: a null payload is an empty one; rows of one id and payload are equal records; a null URL gives a
record without a target; line breaks in a URL are escaped; a damaged member is passed over to the next magic, but
a whole one whose payload doesn't fit its digest is an error; an empty table gives no record; columns other than
id, URL and payload are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish import session

LEAST_REVISIT = 1000
SPLIT_BYTES = 16 << 20
_MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SCHEMA = "path string, size long, records long"


def mark_revisits(pages: DataFrame, page_id: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, payload, digest, refers_to): of equal payloads of `least` bytes or more, all but the largest id
    refer to it.  Digests are counted before anything moves, and only those that repeat are joined."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("last"), F.min("id").alias("first")).where("first < last").select("digest", "last")
    joined = rows.join(repeated, "digest", "left")
    return joined.select("id", "url", "payload", "digest", F.when(F.col("id") < F.col("last"), F.col("last")).alias("refers_to"))


def _record(number: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{number}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str, page_id: str = "page_id", payload: str = "html", least: int = LEAST_REVISIT, level: int = 6, date: str = "1970-01-01T00:00:00Z") -> list[tuple[str, int, int]]:
    """Writes archives below folder (a URI); returns (URI, bytes, records) of each, one for a partition."""
    session.ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        hidden = f"{path}/.{name}.{uuid.uuid4().hex}"
        n = 0
        with fs.open_output_stream(hidden, compression=None) as out:
            info = b"software: lanternfish\r\nformat: WARC File Format 1.1\r\n"
            out.write(_member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", level))
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    out.write(_member(_record(*(x.as_py() for x in row), date=date), level))
                    n += 1
        if n:
            fs.move(hidden, f"{path}/{name}")
            size = fs.get_file_info(f"{path}/{name}").size
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([n])], names=["path", "size", "records"])
        else:
            fs.delete_file(hidden)

    rows = mark_revisits(pages, page_id, payload, least).mapInArrow(run, _SCHEMA).collect()  # a row for a file
    return sorted((r.path, r.size, r.records) for r in rows)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class _Window:
    """Forward reading of a file with a look back of one buffer."""

    def __init__(self, file, start: int) -> None:
        self.file, self.start, self.data = file, start, b""
        file.seek(start)

    def more(self) -> bool:
        chunk = self.file.read(_CHUNK)
        self.data += chunk
        return bool(chunk)

    def forget(self, at: int) -> None:
        self.data, self.start = self.data[at - self.start :], at


def _decode(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The member at a place and the place after it; None if there is no whole WARC record."""
    z, out, place, checked, headed = zlib.decompressobj(31), [], at, False, False
    while True:
        if place - window.start >= len(window.data) and not window.more():
            return None
        part = window.data[place - window.start :]
        try:
            out.append(z.decompress(part))
        except zlib.error:
            return None
        place += len(part)
        if not checked:
            begin = b"".join(out)[:7]
            if not b"WARC/1.".startswith(begin):
                return None
            checked = len(begin) == 7
        if z.eof:
            return (b"".join(out), place - len(z.unused_data)) if checked else None
        if not headed and len(window.data) > 4 * _CHUNK:  # a member this long must have shown its header
            headed = True
            if b"\r\n\r\n" not in b"".join(out):
                return None


def members(fs: pafs.FileSystem, path: str, start: int, end: int) -> Iterator[bytes]:
    """Decoded members whose first byte is in start:end."""
    with fs.open_input_file(path) as file:
        window, at, known = _Window(file, start), start, start == 0
        while at < end:
            if not known:
                while (found := window.data.find(_MAGIC, at - window.start)) < 0:
                    at = max(at, window.start + len(window.data) - 2)
                    if at >= end or not window.more():
                        return
                at = window.start + found
                if at >= end:
                    return
            got = _decode(window, at)
            if got is None:
                if known and at - window.start >= len(window.data) and not window.more():
                    return
                at, known = at + 1, False
                continue
            yield got[0]
            at, known = got[1], True
            window.forget(at)


def parse(member: bytes) -> dict | None:
    """Page records as a dict; None for other types."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = _fields(head)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    number = lambda name: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", fields.get(name, ""))) else None
    size = int(_fields(http)["content-length"])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't fit its digest")
    return {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to"), "payload": payload if kind == "response" else None}


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read(spark: SparkSession, files: list[tuple[str, int]], payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The page records of archives given as (URI, bytes); a task for each range of split_bytes."""
    session.ship_package(spark)
    schema = _READ if payload else _READ.remove(_READ.get_field_index("payload"))
    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    count = sum(-(-size // split_bytes) for _, size in files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(split["path"])
                rows, held = [], 0
                for member in members(fs, path, split["start"], split["stop"]):
                    if (row := parse(member)) is None:
                        continue
                    rows.append(row)
                    held += len(member)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    ranges = spark.createDataFrame(files, "path string, size long").where("size > 0").select("path", "size", begin.alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("stop")).repartition(max(1, count))
    return ranges.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages as archives and reads them back."""
    folder = folder or f"{session.shared_dir(pages.sparkSession)}/warc"
    files = write(pages, folder)
    return read(pages.sparkSession, [f[:2] for f in files], payload=False)
