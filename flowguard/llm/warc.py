"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writer: one gzip member per record (WARC/1.1). Of pages with equal payloads the one with the
smallest page_id is stored as a response, the others as revisits of it that repeat the HTTP header
only. Every task writes files of its own, under names that no other attempt uses, through the file
system that the shared folder's address names; the list of files is a table that Spark commits, so
files of lost attempts are never read.

Reader: files are cut into byte ranges that tasks read alone. A task looks for the first member (or
version line, in files without compression) that starts in its range and reads on from there. When
a record fails a check (gzip CRC, header, length, block digest) the search for the next valid
start begins one byte on. All bytes of no valid record are listed as quarantined gaps.

Nulls: a null html is an empty payload; a null url leaves the target out; rows without page_id are
written under the id ``null``, as responses of none but such rows, and read back as null. Rows that
repeat the smallest page_id of their payload are all responses. Line breaks in an url are escaped.
Empty tables give no archive. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard.llm.common import byte_column, rows_batch, save, shared_folder

DATE = "2000-01-01T00:00:00Z"
VERSION = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
HEADER_BYTES = 1 << 16  # read at first in search of the end of a header
MANIFEST = pa.schema([("path", pa.string()), ("length", pa.int64()), ("n_records", pa.int64())])
RECORD = pa.schema([
    ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("record_type", pa.string()),
    ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
RECORD_SQL = ("path string, start long, end long, record_type string, record_id string, target_uri string, "
              "refers_to string, payload_digest string, payload_bytes long, payload binary")


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def record(page, url, payload: bytes, first) -> bytes:
    """A response, or a revisit of page ``first`` if that is another one."""
    revisit = page != first
    kind = "revisit" if revisit else "response"
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
             % len(payload)) + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        url = url.replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {url}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {_name(first)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def write(pages: DataFrame, least_bytes: int = 0, compress: bool = True,
          folder: str | None = None) -> DataFrame:
    """Write the archives; the table of files: path, length, n_records.

    Payloads of fewer than ``least_bytes`` bytes are always stored whole.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha1(F.col("html").cast("binary"))))
    firsts = rows.groupBy("key").agg(F.min("page_id").alias("first"))
    rows = rows.join(firsts, "key").select("page_id", "url", "html", "first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        out = name = None
        size = n = 0

        def done():
            out.close()
            return rows_batch({"path": [f"{folder}/{name}"], "length": [size], "n_records": [n]}, MANIFEST)

        for batch in batches:
            for page, url, html, first in zip(
                    batch.column("page_id").to_pylist(), batch.column("url").to_pylist(),
                    byte_column(batch, "html"), batch.column("first").to_pylist()):
                if page is None or len(html) < least_bytes:
                    first = page
                data = record(page, url, html, first)
                if compress:
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    data = packer.compress(data) + packer.flush()
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc{'.gz' * compress}", 0, 0
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    yield done()
                    out = None
        if out is not None:
            yield done()
    return save(rows.mapInArrow(work, "path string, length long, n_records long"), "warc-files")


class Damaged(Exception):
    """No valid record starts here."""


class Held:
    """A file read in pieces, of which the part from ``base`` on is held."""

    def __init__(self, stream, at: int):
        self.stream, self.base, self.data, self.over = stream, at, b"", False
        stream.seek(at)

    def upto(self, end: int) -> bool:
        """Hold the bytes before ``end``; false if the file ends sooner."""
        parts, have = [self.data], self.base + len(self.data)
        while have < end and not self.over:
            part = self.stream.read(max(READ_BYTES, end - have))
            self.over = not part
            parts.append(part)
            have += len(part)
        if len(parts) > 1:
            self.data = b"".join(parts)
        return have >= end

    def drop(self, at: int) -> None:
        if at - self.base > READ_BYTES:
            self.data, self.base = self.data[at - self.base:], at

    def find(self, mark: bytes, at: int, limit: int) -> int | None:
        """First place of ``mark`` from ``at`` on and before ``limit``."""
        while at < limit:
            self.drop(at)
            self.upto(min(limit, at + READ_BYTES) + len(mark))
            found = self.data.find(mark, at - self.base, min(limit, at + READ_BYTES) + len(mark) - 1 - self.base)
            if found >= 0:
                return self.base + found
            at = min(limit, at + READ_BYTES)
        return None


def _member(window: Held, at: int) -> tuple[bytes, int]:
    """Content of the gzip member at ``at`` and the place after it."""
    unpack, parts, place = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if not window.upto(place + 1):
                raise Damaged("the file ends in a member")
            piece = window.data[place - window.base:place - window.base + READ_BYTES]
            parts.append(unpack.decompress(piece))
            place += len(piece)
            if len(parts) == 1 and not parts[0].startswith(VERSION[:len(parts[0])]):
                raise Damaged("no record in the member")
    except zlib.error as error:
        raise Damaged(str(error)) from error
    return b"".join(parts), place - len(unpack.unused_data)


def parse(data: bytes, whole: bool) -> tuple[dict, bytes, int]:
    """Header fields, block and size of the record that ``data`` starts with.

    ``whole``: nothing may follow the record, as in a gzip member.
    """
    head = data.find(b"\r\n\r\n")
    if not data.startswith(VERSION) or head < 0:
        raise Damaged("no header")
    fields = {}
    for line in data[:head].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line has no colon")
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    end = head + 4 + int(length)
    block = data[head + 4:end]
    if len(block) < int(length) or data[end:end + 4] != b"\r\n\r\n" or (whole and len(data) != end + 4):
        raise Damaged("the length is wrong")
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != digest_of(block):
        raise Damaged("the block digest is wrong")
    return fields, block, end + 4


def _plain(window: Held, at: int) -> tuple[dict, bytes, int]:
    """The record without compression at ``at``, and the place after it."""
    size = HEADER_BYTES
    while True:  # a header has any length, but no version line
        more = window.upto(at + size)
        view = window.data[at - window.base:at - window.base + size]
        head = view.find(b"\r\n\r\n")
        if head >= 0 or not more or b"\r\n" + VERSION in view:
            break
        size *= 2
    for line in view[:max(head, 0)].split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == b"content-length" and value.strip().isdigit():
            if not window.upto(at + head + 8 + int(value)):
                raise Damaged("the file ends in a record")
            view = window.data[at - window.base:at - window.base + head + 8 + int(value)]
    fields, block, size = parse(view, False)
    return fields, block, at + size


def _fields(path: str, start: int, end: int, fields: dict, block: bytes) -> dict:
    kind = fields.get("warc-type")
    http, _, payload = block.partition(b"\r\n\r\n")
    if not fields.get("content-type", "").startswith("application/http"):
        http, payload = b"", block
    size = len(payload)
    if kind == "revisit":
        payload = None
        size = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n"))
                     if k.strip().lower() == b"content-length" and v.strip().isdigit()), None)
    said = fields.get("warc-payload-digest", "")
    own = digest_of(payload) if payload is not None else None
    if own and said.startswith("sha1:") and said[5:] != own:
        raise Damaged("the payload digest is wrong")
    return {"path": path, "start": start, "end": end, "record_type": kind,
            "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
            "refers_to": fields.get("warc-refers-to"), "payload": payload, "payload_bytes": size,
            "payload_digest": own or said.removeprefix("sha1:") or None}


def salvage(stream, path: str, start: int, end: int) -> Iterator[dict]:
    """Valid records of a file that start in [start, end)."""
    packed = path.endswith(".gz")
    window, mark, at = Held(stream, start), MAGIC if packed else VERSION, start
    while (at := window.find(mark, at, end)) is not None:
        try:
            if packed:
                data, after = _member(window, at)
                fields, block, _ = parse(data, True)
            else:
                fields, block, after = _plain(window, at)
            yield _fields(path, at, after, fields, block)
            at = after
        except Damaged:
            at += 1


def read(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """All valid records of the files of a table with ``path`` and ``length``."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(SPLIT_BYTES).cast("long"))
    splits = files.where("length > 0").select("path", "length", F.explode(starts).alias("start"))
    splits = splits.select("path", "start", F.least("length", F.col("start") + SPLIT_BYTES).alias("end"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as stream:
                    for found in salvage(stream, path, start, end):
                        size += len(found["payload"] or b"") + 300
                        if not with_payload:
                            found["payload"] = None
                        held.append(found)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, RECORD)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, RECORD)
    cores = files.sparkSession.sparkContext.defaultParallelism
    return splits.repartition(max(cores, splits.count()), "path", "start").mapInArrow(work, RECORD_SQL)


def gaps(files: DataFrame, records: DataFrame) -> DataFrame:
    """Quarantined byte ranges: path, start, end of what no valid record covers."""
    ends = files.select("path", F.col("length").alias("start"), F.col("length").alias("end"))
    order = Window.partitionBy("path").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    marks = records.select("path", "start", "end").union(ends)
    return (marks.select("path", F.coalesce(F.max("end").over(order), F.lit(0)).alias("from"), "start")
            .where(F.col("from") < F.col("start"))
            .select("path", F.col("from").alias("start"), F.col("start").alias("end")))


def page_of(record_id: str) -> Column:
    """page_id in a record id of this writer; null for the id ``null``."""
    return F.expr("try_cast(regexp_extract(`{}`, '^<urn:page:(.*)>$', 1) AS BIGINT)".format(record_id))
