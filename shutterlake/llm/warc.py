"""Operator 12: WARC archives of pages, and a reader that salvages what damage leaves.

Writing: pages of equal payloads are found by digest; the one with the smallest page_id
becomes a response, the others revisits of it. Each task writes its records to archives of
its own, one gzip member a record, and gives their paths. The table of these paths is
written by Spark's own commit: an archive of a task that was lost or ran twice is in no
table, so it is never read.

Reading: one task an archive, one record in memory. A record counts if it is framed as it
says and its digests hold. Where a check fails, the reader goes on at the next byte from
which a gzip member opens on a version line, or which is a version line itself; what lies in
between is reported as a gap. A damaged member's records are given as far as they are whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import scratch, table, written

#: Compressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
#: A record's head that is longer is damage.
MOST_HEAD = 64 << 20
MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
END = b"\r\n\r\n"
# fixed values: names of the format
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

FOUND = "kind string, path string, offset long, length long, reason string, record_type string, record_id string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, block: bytes, content_type: str, date: str, **more: str | None) -> bytes:
    """A record as bytes. more: further fields, with _ for - in their names; those that are None are left out, control characters in values are percent-encoded."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, **{k.replace("_", "-"): v for k, v in more.items()}, "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": content_type, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {re.sub('[\\x00-\\x1f\\x7f]', lambda m: f'%{ord(m[0]):02X}', v)}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + END


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """The response of a page, or its revisit of the page `first`. WARC-Payload-Length, a field of our own, says how long a revisit's payload was."""
    http = HTTP.format(len(payload)).encode()
    more = {"WARC_Target_URI": url, "WARC_Payload_Digest": f"sha1:{base32_sha1(payload)}", "WARC_Payload_Length": str(len(payload))}
    if first is None:
        return record(RESPONSE, urn(page_id), http + payload, "application/http;msgtype=response", date, **more)
    return record(REVISIT, urn(page_id), http, "application/http;msgtype=response", date, WARC_Profile=PROFILE, WARC_Refers_To=urn(first), **more)


def planned(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, first): first is the page whose response this one revisits, null for responses.

    Of rows with equal payloads of at least least_bytes, those with the smallest page_id are responses. Rows
    without a page_id come last: they revisit a page that has one, and are responses if there is none. Digests
    alone are grouped, with sums before the shuffle; a payload that a third of all rows share is a skewed key of a join, which Spark splits.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    key = F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload"))
    keyed = rows.withColumn("digest", key)
    groups = keyed.filter("digest is not null").groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).filter("n > 1 and least is not null").drop("n")
    first = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("least")), F.col("least"))
    return keyed.join(groups, "digest", "left").select("page_id", "url", "payload", first.alias("first"))


def archived(plan: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records of a plan (page_id, url, payload, first) to archives in a folder that all executors share; (path, records, bytes) of each, as a written table. The folder is a path or a URI that pyarrow opens."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, name, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": records, "bytes": size}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for page_id, url, payload, first in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    name, records = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)  # else pyarrow compresses by the name
                    info = gzip.compress(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", b"format: WARC File Format 1.1\r\n", "application/warc-fields", date, WARC_Filename=name), mtime=0)
                    size = out.write(info)
                size += out.write(gzip.compress(page_record(page_id, url, payload, first, date), 6, mtime=0))
                records += 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written(plan.select("page_id", "url", "payload", "first").mapInArrow(told, "path string, records long, bytes long"), "archives")


class Damaged(Exception):
    """A check that failed, as a reason."""


@dataclass
class Found:
    """A record; offset: of its member, or of itself where it is in none; end: where that ends, for the last record of a member."""

    head: dict[str, str]
    block: bytes
    size: int
    sure: bool
    offset: int = 0
    end: int | None = None

    def payload(self) -> bytes:
        """What follows the head of the HTTP message, or the block of other records."""
        if not self.head.get("content-type", "").startswith("application/http"):
            return self.block
        at = self.block.find(END)
        return self.block[at + 4 :] if at >= 0 else b""


@dataclass
class Gap:
    offset: int
    end: int
    reason: str


@dataclass
class Window:
    """Bytes of a stream from some place on, fetched as they are needed; left: how many there are, peek: those at a place ahead, where that is known."""

    chunks: Iterator[bytes]
    left: int | None = None
    peek: Callable[[int, int], bytes] | None = None
    bytes: bytearray = field(default_factory=bytearray)

    def fill(self, n: int) -> bool:
        """Whether there are n bytes."""
        if self.left is not None and n > self.left:
            return False
        while len(self.bytes) < n:
            chunk = next(self.chunks, None)
            if chunk is None:
                return False
            self.bytes += chunk
        return True

    def drop(self, n: int) -> None:
        del self.bytes[:n]
        if self.left is not None:
            self.left -= n

    def find(self, what: bytes, start: int, most: int) -> int:
        """Where what begins at or after start; -1 if it doesn't end within most bytes."""
        while (at := self.bytes.find(what, start)) < 0:
            start = max(start, len(self.bytes) - len(what) + 1)
            if len(self.bytes) > most or not self.fill(len(self.bytes) + 1):
                return -1
        return at


def parsed(window: Window) -> Found:
    """The record at the window's beginning."""
    if not window.fill(10) or not VERSION.match(window.bytes):
        raise Damaged("no version line")
    head, at = {}, 10
    while True:
        end = window.find(b"\r\n", at, MOST_HEAD)
        if end < 0:
            raise Damaged("a head without an end")
        if end == at:
            break
        name, colon, value = bytes(window.bytes[at:end]).partition(b":")
        if not colon:
            raise Damaged("a line of the head is no field")
        head[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        at = end + 2
    if not head.get("warc-type") or not head.get("warc-record-id"):
        raise Damaged("no type or no identifier")
    length = head.get("content-length", "")
    if not re.fullmatch("[0-9]+", length):
        raise Damaged("no content length")
    start = at + 2
    end = start + int(length)
    if window.peek and window.left >= end + 4 and window.peek(end, 4) != END:  # before a wrong length fills the memory
        raise Damaged("the record does not end where it says")
    if not window.fill(end + 4):
        raise Damaged("the record is cut short")
    if window.bytes[end : end + 4] != END:
        raise Damaged("the record does not end where it says")
    found = Found(head, bytes(window.bytes[start:end]), end + 4, False)
    digests = [("warc-block-digest", lambda: found.block)] + [("warc-payload-digest", found.payload)] * (head.get("warc-type") == RESPONSE)
    for name, data in digests:
        kind, _, value = head.get(name, "").partition(":")
        if kind.lower() == "sha1":
            if value != base32_sha1(data()):
                raise Damaged(f"{name} differs")
            found.sure = True
    return found


def inflated(file: pa.NativeFile, at: int, size: int, ends: list[int]) -> Iterator[bytes]:
    """The bytes of the gzip member at a place; its end is added to ends once its check sum holds."""
    way = zlib.decompressobj(31)
    data = b""
    while not way.eof:
        if not data:
            data = file.read_at(min(CHUNK, size - at), at) if at < size else b""
            if not data:
                raise Damaged("the member is cut short")
            at += len(data)
        try:
            out = way.decompress(data, CHUNK)
        except zlib.error as error:
            raise Damaged(f"the member does not inflate: {error}") from None
        data = way.unconsumed_tail
        if out:
            yield out
    ends.append(at - len(way.unused_data))


def member(file: pa.NativeFile, at: int, size: int) -> Iterator[Found]:
    """The records of a gzip member. The last one is held back until the member's check has passed, unless a digest of its own makes it sure."""
    ends: list[int] = []
    window, held, flaw = Window(inflated(file, at, size, ends)), None, ""
    try:
        while window.fill(1):
            try:
                found = parsed(window)
            except Damaged as damage:
                flaw = flaw or str(damage)
                while (next_one := window.find(b"WARC/1.", 1, CHUNK)) < 0 and window.fill(len(window.bytes) + 1):
                    window.drop(len(window.bytes) - 8)
                if next_one < 0:
                    break
                window.drop(next_one)
                continue
            if held:
                yield held
            held = found
            window.drop(found.size)
        if not ends:
            for _ in window.chunks:
                pass
    except Damaged as damage:
        if held and held.sure:
            yield held
        raise Damaged(flaw or str(damage)) from None
    if flaw or not held:
        if held:
            yield held
        raise Damaged(flaw or "the member is empty")
    held.end = ends[0]
    yield held


def plain(file: pa.NativeFile, at: int, size: int) -> Iterator[Found]:
    """The uncompressed record at a place."""
    chunks = (file.read_at(min(CHUNK, size - x), x) for x in range(at, size, CHUNK))
    found = parsed(Window(chunks, size - at, lambda ahead, n: file.read_at(n, at + ahead)))
    found.end = at + found.size
    yield found


def next_start(file: pa.NativeFile, at: int, size: int) -> int:
    """The next place from at on where a gzip member opens on a version line, or a version line stands; size if there is none."""
    while at < size:
        data = file.read_at(min(CHUNK, size - at), at)
        for m in re.finditer(re.escape(MAGIC) + rb"|WARC/1\.[01]\r", data):
            place = at + m.start()
            if m[0] != MAGIC:
                return place
            try:
                if zlib.decompressobj(31).decompress(file.read_at(min(4096, size - place), place), 16).startswith(b"WARC/1."):
                    return place
            except zlib.error:
                continue
        if at + len(data) >= size:
            return size
        at += len(data) - 16
    return size


def salvaged(file: pa.NativeFile) -> Iterator[Found | Gap]:
    """All records of an archive that pass their checks, and the gaps between them."""
    size, at = file.size(), 0
    bad, reason = None, ""
    while at < size:
        end = None
        try:
            for found in (member if file.read_at(min(3, size - at), at) == MAGIC else plain)(file, at, size):
                if bad is not None:
                    yield Gap(bad, at, reason)
                    bad = None
                found.offset, end = at, found.end
                yield found
        except Damaged as damage:
            if bad is None:
                bad, reason = at, str(damage)
            at = next_start(file, at + 1, size)
            continue
        at = end
    if bad is not None:
        yield Gap(bad, size, reason)


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """(kind, path, offset, length, reason, record_type, ..., payload): a row of kind record for each whole record of the archives (path), and one of kind gap for each run of bytes that gave none.

    Archives may be compressed or not, or both. Empty archives give no rows; a null path gives none. Of revisits, length
    and digest of the payload are what their fields say. A file of nothing but damage is one gap.
    """
    names, kinds = [c.split()[0] for c in FOUND.split(", ")], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FOUND.split(", ")])

    def row(path: str, found: Found | Gap) -> dict:
        if isinstance(found, Gap):
            return {"kind": "gap", "path": path, "offset": found.offset, "length": found.end - found.offset, "reason": found.reason}
        head, own = found.head, {}
        if head.get("warc-type") == REVISIT:
            stated = head.get("warc-payload-length", "")
            own = {"payload_bytes": int(stated) if re.fullmatch("[0-9]{1,18}", stated) else None, "payload_digest": head.get("warc-payload-digest", "").rpartition(":")[2] or None}
        else:
            payload = found.payload()
            own = {"payload_bytes": len(payload), "payload_digest": base32_sha1(payload), "payload": payload if payloads else None}
        place = {"kind": "record", "path": path, "offset": found.offset, "length": found.end - found.offset if found.end else None}
        return place | {"record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"), "url": head.get("warc-target-uri")} | own

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_file(place) as file:
                    for found in salvaged(file):
                        rows.append(row(path, found))
                        held += len(rows[-1].get("payload") or b"") + 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    there = paths.filter("path is not null").select("path")
    return there.repartition(max(1, min(there.count(), 100_000))).mapInArrow(told, FOUND).select(*names)


def page_of(column: str) -> Column:
    return F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def archived_pages(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row of pages (page_id, url, html), written to archives in a folder and read back.

    A null html is an empty payload, a null url is left out, a null page_id comes back as null; rows that share a
    page_id are records of their own that share an identifier, and with equal payloads all of the smallest page_id are
    responses. Other columns are left out, whatever their names. An empty table gives no archive and no row.
    """
    found = read_archives(archived(planned(pages, least_bytes), folder), payloads=False).filter(F.col("record_type").isin(RESPONSE, REVISIT))
    return found.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
