"""WARC records in ZIP archives: written with an index, read back by ranges and never extracted.

Archives are files in the folder that all executors share, written and read by the tasks through Arrow's file systems; where that
folder is in a store that these don't open, they are kept as cells of a table instead. An archive is a ZIP of stored members: ``records.warc``, the records end to end, and ``index.cdxj``, a line for each record with
its offset and length. The reader needs only read(offset, length): it takes the end record, the ZIP64 records where sizes call
for them, the central directory and a member's local header, then the index, then ranges of records that lie together.

Of pages with equal payloads of at least MIN_REVISIT bytes, that with the smallest page_id is a response and the others are
revisits that name it. Digests are summed before they are shuffled, so a payload that a third of all pages share is no load.

Defined results: a null html is an empty payload. Rows that repeat the smallest page_id are responses too. A null page_id
sorts last; if it is the only one it is a response. A null url has no header; control characters in a url are percent-coded.
Other columns are not read. An empty table makes no archives. Payloads of any length are stored whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir, written

MIN_REVISIT = 0
ARCHIVE_BYTES = 8 << 20
#: Records that lie together are read in ranges of about so many bytes.
RANGE_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
Read = Callable[[int, int], bytes]


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit holds the HTTP headers alone, which still tell the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def archive(records: list[tuple[int | None, bytes]]) -> bytes:
    """A ZIP of the records and their index, the same bytes for the same records."""
    lines, at = [], 0
    for page_id, rec in records:
        lines.append(json.dumps({"page_id": page_id, "offset": at, "length": len(rec)}))
        at += len(rec)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in (("records.warc", b"".join(r for _, r in records)), ("index.cdxj", "\n".join(lines).encode())):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def members(read: Read, size: int) -> list[Member]:
    """The central directory of a ZIP, with or without ZIP64 records."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and len(tail) - end - 22 < struct.unpack_from("<H", tail, end + 20)[0]:
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("not a ZIP archive")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, at):
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("ZIP64 locator is missing")
        (end64,) = struct.unpack_from("<Q", locator, 8)
        record64 = read(end64, 56)
        if record64[:4] != END64:
            raise ValueError("ZIP64 end record is missing")
        count, length, at = struct.unpack_from("<QQQ", record64, 32)
    raw, p, out = read(at, length), 0, []
    for _ in range(count):
        if raw[p : p + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, p + 8)
        _, full = packed_full = struct.unpack_from("<II", raw, p + 20)
        n, extra, note = struct.unpack_from("<HHH", raw, p + 28)
        (header,) = struct.unpack_from("<I", raw, p + 42)
        name = raw[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        x, x_end = p + 46 + n, p + 46 + n + extra
        while x + 4 <= x_end:
            kind, m = struct.unpack_from("<HH", raw, x)
            if kind == 1:  # its fields stand only for those that overflow, in this order
                y = x + 4
                if full == 0xFFFFFFFF:
                    (full,), y = struct.unpack_from("<Q", raw, y), y + 8
                if packed_full[0] == 0xFFFFFFFF:
                    y += 8
                if header == 0xFFFFFFFF:
                    (header,) = struct.unpack_from("<Q", raw, y)
            x += 4 + m
        out.append(Member(name, method, full, header))
        p += 46 + n + extra + note
    return out


def data_at(read: Read, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    head = read(member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    n, extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + extra


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers by lower-case name, the HTTP header block, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    http, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
    return headers, http, payload


def records(read: Read, size: int) -> Iterator[tuple[int | None, bytes]]:
    """(page_id, record) of every record that an archive's index names."""
    found = {m.name: m for m in members(read, size)}
    base = data_at(read, found["records.warc"])
    index = found["index.cdxj"]
    lines = [json.loads(x) for x in bytes(read(data_at(read, index), index.size)).decode().splitlines()]
    i = 0
    while i < len(lines):
        j, at = i + 1, lines[i]["offset"]
        end = at + lines[i]["length"]
        while j < len(lines) and lines[j]["offset"] == end and end - at < RANGE_BYTES:
            end, j = end + lines[j]["length"], j + 1
        block = bytes(read(base + at, end - at))
        for e in lines[i:j]:
            yield e["page_id"], block[e["offset"] - at : e["offset"] - at + e["length"]]
        i = j


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, bytes]] = []
    n = 0
    for batch in batches:
        for page_id, url, html, first, revisit in zip(*(batch.column(i) for i in range(5)), strict=True):
            payload = (html.as_py() or "").encode()
            rec = record(page_id.as_py(), url.as_py(), payload, first.as_py(), revisit.as_py())
            held.append((page_id.as_py(), rec))
            n += len(rec)
            if n >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_pydict({"n_records": [len(held)], "archive": [archive(held)]})
                held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({"n_records": [len(held)], "archive": [archive(held)]})


def write_archives(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(n_records, archive) with a record for every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    shared = rows.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = written(shared.select(F.col("digest").alias("d"), "first"), "shared")
    both = rows.join(shared, F.col("digest") == F.col("d"), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return both.select("page_id", "url", "html", "first", revisit.alias("revisit")).mapInArrow(_write, "n_records bigint, archive binary")


def _files(folder: str):  # noqa: ANN202
    """Archives to files named by their content, so that a task that runs again writes the same ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for n, a in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = a.as_buffer()
                name = f"{hashlib.sha256(data).hexdigest()}.zip"
                part = f"{root}/{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(data)
                fs.move(part, f"{root}/{name}")
                yield pa.RecordBatch.from_pydict({"n_records": [n], "bytes": [data.size], "file": [name]})

    return run


def stored(archives: DataFrame) -> DataFrame:
    """(n_records, bytes, file, folder) of archives as files in the shared folder; as they are where Arrow can't open it."""
    folder = f"{shared_dir(archives.sparkSession)}/archives-{uuid.uuid4().hex}"
    try:
        pafs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, OSError):
        return written(archives, "archives")
    files = archives.mapInArrow(_files(folder), "n_records bigint, bytes bigint, file string")
    return written(files.withColumn("folder", F.lit(folder)), "archive-files").distinct()


def _parsed(read: Read, size: int) -> pa.RecordBatch:
    rows = []
    for page_id, raw in records(read, size):
        headers, http, payload = parse_record(raw)
        full = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if headers["warc-type"] == "response" and (digest_of(payload) != digest or len(payload) != full):
            raise ValueError(f"payload of page {page_id} doesn't match its record")
        first = headers.get("warc-refers-to")
        rows.append({"page_id": page_id, "payload_bytes": full, "payload_digest": digest, "record_type": headers["warc-type"], "refers_to": int(first.removeprefix("<urn:page:").removesuffix(">")) if first else None, "url": headers.get("warc-target-uri")})
    return pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in batch.column(0):
            data = memoryview(a.as_buffer())
            yield _parsed(lambda at, n: bytes(data[at : at + n]), len(data))  # noqa: B023


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, name, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            fs, root = pafs.FileSystem.from_uri(folder)
            with fs.open_input_file(f"{root}/{name}") as f:
                yield _parsed(lambda at, n: f.read_at(n, at), size)  # noqa: B023


RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def read_records(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every record in archives, stored as files or cells."""
    kinds = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"
    if "archive" in archives.columns:
        return archives.select("archive").mapInArrow(_digests, kinds)
    return archives.select("folder", "file", "bytes").mapInArrow(_ranges, kinds)


def query(spark, sf_dir):  # noqa: ANN001, ANN201
    from .shared import table

    return read_records(stored(write_archives(table(spark, sf_dir, "pages")))).drop("url")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(d, CAST(i * 5 + 1 AS INT), 5) AS BIGINT)) AS c FROM g)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(c, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v // 32768 % 32 + 1 AS INT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v // 1024 % 32 + 1 AS INT), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v // 32 % 32 + 1 AS INT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v % 32 + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
