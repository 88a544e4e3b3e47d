"""WARC archives of pages: a writer with revisit records, and a reader that splits compressed files.

Every record is a gzip member of its own. A reading task gets a range of bytes: it looks for the
gzip magic from the start of the range, takes a candidate as a member only if it decodes to a WARC
header and its checksum holds, and then follows member after member. It owns the records whose
members start in its range, wherever they end, so ranges may cut anywhere.

Of records with equal payloads the one with the least page_id is the response, and the others
revisit it without repeating the payload. Response payloads are hashed again when read.

Defined results: null html is the empty payload; a null url writes no target; a null page_id is
kept as null and is the response only if no equal payload has an id; rows with the same page_id and
payload are all responses if that id is the least; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm import files
from meterlake.llm.common import lookup, shared_folder, stored, whole

MIN_BYTES = 0
#: Bytes of an archive after which a task starts the next, and bytes of an archive for one reading task.
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
MAGIC = b"\x1f\x8b\x08"
READ = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
MANIFEST = "path string, bytes long, records long"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD_ID = re.compile(r"<urn:page:(-?\d*)>")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _address(url: str) -> str:
    """A url that can stand in a header: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A compressed WARC record."""
    block = HTTP.format(len(payload)).encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_address(url)}"] if url is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _written(batches: Iterator, folder: str) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    rows = (row for batch in batches for row in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True))
    task, part, row = TaskContext.get().partitionId(), 0, next(rows, None)
    while row is not None:
        path, size, n = f"{folder}/pages-{task:08d}-{part:05d}.warc.gz", 0, 0
        with files.writing(path) as out:
            while row is not None and size < ARCHIVE_BYTES:
                page_id, url, source, first, revisit = row
                data = record(page_id, url, source.encode("utf-8", "replace"), first, revisit)
                out.write(data)
                size, n, row = size + len(data), n + 1, next(rows, None)
        part += 1
        yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "records": n}])


def write(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write a record per page; a stored row per archive with its path, bytes and records."""
    folder = shared_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), whole("html").alias("html")).withColumn("key", F.sha1("html"))
    firsts = stored(rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")), "payloads")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    typed = lookup(rows, firsts, "key", "n", total)
    revisit = ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= min_bytes)
    given = typed.select("page_id", "url", "html", "first", revisit.alias("revisit"))
    return stored(given.mapInArrow(lambda b: _written(b, folder), MANIFEST), "warc-manifest")


class Member:
    """A gzip member that begins at ``start`` of a file: its bytes, or None if it is none."""

    def __init__(self, source, start: int, size: int):
        self.data: bytes | None = None
        self.stop = start
        unpack, out, at = zlib.decompressobj(31), [], start
        try:
            while not unpack.eof and at < size:
                source.seek(at)
                chunk = source.read(min(READ, size - at))
                at += len(chunk)
                out.append(unpack.decompress(chunk))
                if len(out) == 1 and not out[0].startswith(b"WARC/1."[: len(out[0])]):
                    return
        except zlib.error:
            return
        if unpack.eof and headers(b"".join(out)) is not None:
            self.data, self.stop = b"".join(out), at - len(unpack.unused_data)


def headers(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """The named fields of a record and its block, or None if it is no whole WARC record."""
    head, parted, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not parted or not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = fields.get("content-length", "")
    if not n.isdigit() or len(rest) < int(n):
        return None
    return fields, rest[: int(n)]


def members(source, start: int, stop: int, size: int) -> Iterator[bytes]:
    """The records whose members start in the range of bytes."""
    at, held, base = start, b"", start
    while at < stop:
        member = Member(source, at, size) if _magic_at(source, at) else None
        if member is not None and member.data is not None:
            yield member.data
            at = member.stop
            continue
        at, found = at + 1, False  # look for the next magic, also where it lies across two reads
        while at < stop and not found:
            source.seek(at)
            held, base = source.read(READ + 2), at
            k = held.find(MAGIC)
            if k >= 0:
                at, found = base + k, True
            elif len(held) < READ + 2:
                at = stop
            else:
                at = base + READ
    return


def _magic_at(source, at: int) -> bool:
    source.seek(at)
    return source.read(3) == MAGIC


def parsed(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, payload digest, type and page_id referred to of a record."""
    fields, block = headers(data)
    kind = fields["warc-type"]
    number = lambda key: int(RECORD_ID.match(fields[key])[1] or 0) if RECORD_ID.match(fields[key])[1] else None
    head, _, payload = block.partition(b"\r\n\r\n")
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if digest(payload) != told:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        return number("warc-record-id"), len(payload), told, kind, None
    n = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    return number("warc-record-id"), n, told, kind, number("warc-refers-to")


def _read(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for path, start, stop, size in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
            rows = []
            with files.random_access(path) as source:
                for data in members(source, start, stop, size):
                    rows.append(parsed(data))
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of the archives, read by ranges of bytes."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("path", starts.alias("start"), "bytes")
    parts = max(8, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("stop"), "bytes")
    return rows.repartition(parts).mapInArrow(_read, SCHEMA)
