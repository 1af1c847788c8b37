"""WARC archives: one gzip member per record, repeated payloads as revisits, and a reader that splits any file.

Reading: a task gets a byte range, looks for the gzip magic in it, and takes a candidate only if its header
inflates to a WARC header and its checksum holds. It owns every record that starts inside its range, whatever the
range cuts. A range's first run of members that ends before the range does is either nested in a stored payload or
followed by damaged or foreign bytes; the file is then read from its start for a sound member that reaches across the
run, and only such a run is passed over. So archives nested in a sound payload are not taken for records as long as
they are smaller than a range. A member that fails to inflate loses only itself: the search goes on behind it, and
records stored in its payload count as records.

Defined results: a NULL page is the empty payload; a NULL url has no target header; rows that share the largest
page id and the payload are all responses; a NULL page id revisits its twins if any has an id; equal rows give
equal records; an empty table gives no file and no record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from .common import materialize, slices, with_output

MAGIC = b"\x1f\x8b\x08"
#: Shortest payload that is stored once and revisited.
REVISIT_BYTES = 1000
#: Bytes of one reading task.
SPLIT_BYTES = 32 << 20
#: Groups of equal payloads whose keys are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 200_000
_READ = 1 << 18
_URN = "urn:x-page:"
#: Fixed, so that the same pages give the same archive.
DATE = "2026-01-01T00:00:00Z"

FIELDS = [
    ("path", pa.string()),
    ("offset", pa.int64()),
    ("record_type", pa.string()),
    ("page_id", pa.int64()),
    ("refers_to", pa.int64()),
    ("url", pa.string()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("payload", pa.binary()),
]
SCHEMA = (
    "path string, offset long, record_type string, page_id long, refers_to long, url string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None) -> bytes:
    """One record as a gzip member; ``response`` is the page that a revisit refers to."""
    revisit = response is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if revisit:
        head.append(f"WARC-Refers-To: <{_URN}{response}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(record: bytes, path: str, offset: int) -> tuple:
    """The values of ``FIELDS``; digest and length are taken from the payload where the record has one."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    named = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines if ":" in line)}
    block = rest[: int(named.get("content-length", len(rest)))]
    http, payload = {}, block
    if named.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        told = (line.split(":", 1) for line in top.decode("latin-1").split("\r\n")[1:] if ":" in line)
        http = {k.strip().lower(): v.strip() for k, v in told}
    kind = named.get("warc-type")
    if kind == "revisit":
        size = int(http["content-length"]) if "content-length" in http else None
        digest = _hex(named.get("warc-payload-digest"))
        payload = None
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return (path, offset, kind, _page(named.get("warc-record-id")), _page(named.get("warc-refers-to")),
            named.get("warc-target-uri"), size, digest, payload)


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(rf"<{_URN}(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _hex(digest: str | None) -> str | None:
    from base64 import b32decode

    if not digest or ":" not in digest:
        return None
    value = digest.split(":", 1)[1]
    return b32decode(value).hex() if len(value) == 32 else value.lower()


def inflate(file, size: int, at: int) -> tuple[bytes, int] | None:
    """The WARC record of the member at ``at`` and the offset behind it; None if there is no such member."""
    unpacker, out, position, checked = zlib.decompressobj(31), [], at, False
    while not unpacker.eof:
        data = file.read_at(min(_READ, size - position), position)
        if not data:
            return None
        position += len(data)
        try:
            out.append(unpacker.decompress(data))
        except zlib.error:
            return None
        if not checked:
            out = [b"".join(out)]
            checked = len(out[0]) >= 5
            if checked and not out[0].startswith(b"WARC/"):
                return None
    return (b"".join(out), position - len(unpacker.unused_data)) if checked else None


def candidates(file, size: int, start: int, end: int) -> Iterator[int]:
    """Offsets of the gzip magic that start inside the range."""
    at, end = start, min(end, size)
    while at < end:
        data = file.read_at(min(_READ, size - at), at)
        found = data.find(MAGIC)
        while found >= 0 and at + found < end:
            yield at + found
            found = data.find(MAGIC, found + 1)
        at += max(1, len(data) - len(MAGIC) + 1)


def _follows(file, size: int, at: int) -> bool:
    return at >= size or file.read_at(min(len(MAGIC), size - at), at) == MAGIC


def span(file, size: int, at: int) -> int | None:
    """The offset behind the sound gzip member at ``at``, whatever it holds; None if there is none."""
    unpacker, position, data = zlib.decompressobj(31), at, b""
    while not unpacker.eof:
        if not data:
            data = file.read_at(min(_READ, size - position), position)
            position += len(data)
            if not data:
                return None
        try:
            unpacker.decompress(data, _READ)
        except zlib.error:
            return None
        data = unpacker.unconsumed_tail
    return position - len(unpacker.unused_data)


def enclosing(file, size: int, at: int) -> int | None:
    """The offset behind the sound member that starts before ``at`` and reaches across it; None if there is none."""
    beyond = 0
    for start in candidates(file, size, 0, at):
        if start >= beyond and (stop := span(file, size, start)) is not None:
            if stop > at:
                return stop
            beyond = stop
    return None


def first_member(file, size: int, start: int, end: int, outer: bool) -> int | None:
    """Where the range's first own record starts; ``outer`` if no member is known to reach across ``start``."""
    beyond = start
    for at in candidates(file, size, start, end):
        if at < beyond:
            continue
        if inflate(file, size, at) is None:
            beyond = span(file, size, at) or beyond  # another gzip member is passed over whole
            continue
        if outer:
            return at
        here, run = at, at
        while run is not None and here < min(end, size):
            run = span(file, size, here)
            here = run or here
        if run is not None:
            return at  # the run goes on behind the range, or ends with the file
        stop = enclosing(file, size, at)
        if stop is None:
            return at
        beyond, outer = stop, True
    return None


def records(file, size: int, start: int, end: int, path: str) -> Iterator[tuple]:
    at = first_member(file, size, start, end, start == 0)
    while at is not None and at < min(end, size):
        found = inflate(file, size, at)
        if found is None:
            at = first_member(file, size, at, end, True)
            continue
        yield parse(found[0], path, at)
        at = found[1] if _follows(file, size, found[1]) else first_member(file, size, found[1], end, True)


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def marked_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages with payload, digest, and the page that each repeated payload refers to."""
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        pages["url"].alias("url"),
        F.coalesce(pages["html"], F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    groups = long.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
    groups = materialize(groups.where("copies > 1").select("digest", "response"), spark, "payloads")
    small = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(groups) if small else groups, "digest", "left")
    own = F.col("response").eqNullSafe(F.col("page_id")) | F.col("response").isNull()
    return joined.select("page_id", "url", "payload", "digest", F.when(~own, F.col("response")).alias("response"))


def write(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """One archive per partition below ``folder``; returns the stored manifest: path, size, records."""
    folder = folder or work_dir(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, size, n = None, 0, 0
        for batch in batches:
            for part in slices(batch, "payload"):
                if stream is None:
                    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
                    system.create_dir(root, recursive=True)
                    path = f"{root}/pages-{uuid.uuid4().hex}.warc.gz"  # the manifest names the kept attempt's file
                    stream = system.open_output_stream(path, compression=None)
                payloads = part.column(2).cast(pa.binary()).to_pylist()
                columns = [part.column(i).to_pylist() for i in (0, 1, 3, 4)]
                for page, url, digest, response, payload in zip(*columns, payloads, strict=True):
                    data = member(page, url, payload, digest, response)
                    stream.write(data)
                    size, n = size + len(data), n + 1
        if stream is not None:
            stream.close()
            yield with_output([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())], [[path], [size], [n]])

    written = marked_pages(spark, pages).mapInArrow(run, "path string, size long, records long")
    return materialize(written, spark, "archives")


def read(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Every record of the files (path, size), each range of ``split_bytes`` read by a task of its own."""
    starts = F.expr(f"explode(sequence(0L, greatest(size - 1, 0L), {int(split_bytes)}L))")
    ranges = files.where("size > 0").select("path", "size", starts.alias("start"))
    n = ranges.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, held_bytes = [], 0
                with _open(path) as file:
                    for row in records(file, size, start, start + split_bytes, path):
                        held.append(row if payloads else (*row[:-1], None))
                        held_bytes += len(held[-1][-1] or b"") + 200
                        if held_bytes > 8 << 20:
                            yield with_output(FIELDS, list(zip(*held, strict=True)))
                            held, held_bytes = [], 0
                if held:
                    yield with_output(FIELDS, list(zip(*held, strict=True)))

    return ranges.repartition(max(1, min(n, 20_000))).mapInArrow(run, SCHEMA)
