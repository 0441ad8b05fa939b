"""Operator 8: WARC records in ZIP-packaged archives, written and range-read without extraction.

Writing: rows whose payload equals that of an earlier row (smallest page id) become ``revisit``
records. Only the digests of repeated payloads are gathered for that, in a table; the html itself is
moved only when that table is too large for Spark to broadcast by its own measured size. Each task
streams its rows into archives of about ``archive_bytes``: a ZIP64 file with two stored members, the
records (one gzip member each) and an index line per record.

Reading: one row per archive is dealt out; a task reads the end record, the ZIP64 records, the
central directory and the index, then fetches each record by its byte range.

Archives go below ``spark.checkpoint.dir`` under fresh names; a task that runs twice writes another
file, and only files named in the manifest (of the attempt that succeeded) are read.

Defined results: null html is the empty payload, null url leaves out the target; rows with a null
id are never the first of a group unless all are null (then each is a response); repeated rows
with the smallest id are all responses; other columns are not read, whatever their names; no
rows give no archive and no records. Payload sizes are full in revisit records as well.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import map_arrow, written
from chorus.session import scratch_path

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MANIFEST = "path string, bytes long, records long"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, " \
       "payload_digest string, payload binary"

# FIXED VALUES of the ZIP format: signatures and the marker for "see the ZIP64 field".
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
BIG16, BIG32 = 0xFFFF, 0xFFFFFFFF


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store behind a URI or a plain path, as tasks open it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


# -- ZIP container ---------------------------------------------------------------------------

def zip_members(members: list[tuple[str, bytes]]) -> list[bytes]:
    """The chunks of a ZIP64 file with stored members."""
    out, central, at = [], [], 0
    for name, data in members:
        raw, crc, start = name.encode(), zlib.crc32(data), at
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        head = LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 33, crc, BIG32, BIG32, len(raw), len(extra)) + raw + extra
        out += [head, data]
        at += len(head) + len(data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), start)
        central.append(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, BIG32, BIG32, len(raw),
                                             len(extra), 0, 0, 0, 0, BIG32) + raw + extra)
    size, n = sum(map(len, central)), len(central)
    end64 = END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, at)
    locator = LOCATOR64 + struct.pack("<IQI", 0, at + size, 1)
    end = END + struct.pack("<HHHHIIH", 0, 0, BIG16, BIG16, BIG32, BIG32, 0)
    return [*out, *central, end64, locator, end]


def _at(f, offset: int, size: int) -> bytes:
    data = f.read_at(size, offset)
    if len(data) != size:
        raise ValueError(f"archive is cut short: {size} bytes wanted at {offset}, {len(data)} there")
    return data


def directory(f) -> dict[str, tuple[int, int, int, int]]:
    """name -> (offset of its local header, stored size, method, crc) from the central directory.

    Looks for the end record within the last 64 KiB (it may carry a comment) and follows the
    ZIP64 locator when a field of the end record says so.
    """
    total = f.size()
    tail = _at(f, max(0, total - 65_557), min(total, 65_557))
    at = len(tail)
    while True:
        at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    n, size, start = struct.unpack_from("<HII", tail, at + 10)
    if n == BIG16 or size == BIG32 or start == BIG32:
        where = total - len(tail) + at - 20
        loc = _at(f, where, 20) if where >= 0 else b""
        if loc[:4] == LOCATOR64:
            end64 = _at(f, struct.unpack_from("<Q", loc, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("the ZIP64 locator leads nowhere")
            n, size, start = struct.unpack_from("<QQQ", end64, 32)
    listing, pos, out = _at(f, start, size), 0, {}
    for _ in range(n):
        if listing[pos:pos + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method, crc, packed, plain, name_len, extra_len, note_len = struct.unpack_from("<H4xIIIHHH", listing, pos + 10)
        local = struct.unpack_from("<I", listing, pos + 42)[0]
        name = listing[pos + 46:pos + 46 + name_len].decode()
        extra = listing[pos + 46 + name_len:pos + 46 + name_len + extra_len]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:  # in this order, and only those that are marked in the fixed part
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                plain = next(wide) if plain == BIG32 else plain
                packed = next(wide) if packed == BIG32 else packed
                local = next(wide) if local == BIG32 else local
            extra = extra[4 + length:]
        out[name] = (local, packed, method, crc)
        pos += 46 + name_len + extra_len + note_len
    return out


def data_start(f, entry: tuple[int, int, int, int]) -> int:
    """Where a stored member's bytes begin: its local header has its own name and extra lengths."""
    local, _, method, _ = entry
    if method:
        raise ValueError("member is compressed; only stored members can be range-read")
    head = _at(f, local, 30)
    if head[:4] != LOCAL:
        raise ValueError("damaged local header")
    return local + 30 + sum(struct.unpack_from("<HH", head, 26))


# -- records ---------------------------------------------------------------------------------

def _line(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id, url, payload: bytes, first, date: str) -> tuple[bytes, dict]:
    """One gzip member with the record, and its index entry without offset and length."""
    revisit = first is not None and first != page_id
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body += b"" if revisit else payload
    kind = "revisit" if revisit else "response"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{first}>"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0), {"id": page_id, "type": kind}


def parse_record(raw: bytes) -> tuple:
    """A ``READ`` row from one decompressed record; a response's payload is checked by digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    field = dict(x.split(": ", 1) for x in lines)
    http, _, payload = rest[: int(field["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    kind, digest = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: int(x.removeprefix("<urn:page:").rstrip(">")) if x else None
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {field.get('WARC-Record-ID')} does not match its digest")
    url = field.get("WARC-Target-URI")
    return (number(field.get("WARC-Record-ID")), None if url is None else _plain(url), kind,
            number(field.get("WARC-Refers-To")), size, digest, None if kind == "revisit" else payload)


# -- operators -------------------------------------------------------------------------------

def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   archive_bytes: int = 32_000_000, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write all rows; returns the manifest (``MANIFEST``), one row per archive."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")) \
        .withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    same = written(src.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                   .filter("n > 1").drop("n"), "warc-same")
    rows = src.join(same, "digest", "left").select("page_id", "url", "html", "first")
    root = scratch_path(pages.sparkSession, "warc")

    def run(batches):
        fs, path = file_system(root)
        fs.create_dir(path, recursive=True)
        ctx, n = TaskContext.get(), 0
        parts, index, size = [], [], 0

        def flush():
            nonlocal parts, index, size, n
            name = f"{path}/part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{n}.zip"
            lines = "".join(json.dumps(x) + "\n" for x in index).encode()
            chunks = zip_members([(RECORDS, b"".join(parts)), (INDEX, lines)])
            with fs.open_output_stream(name) as out:
                for c in chunks:
                    out.write(c)
            row = pa.record_batch([pa.array([f"{root}/{name.rpartition('/')[2]}"]), pa.array([sum(map(len, chunks))], pa.int64()),
                                   pa.array([len(index)], pa.int64())], names=["path", "bytes", "records"])
            parts, index, size, n = [], [], 0, n + 1
            return row

        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                raw, entry = record(page_id, url, html.encode(), first, date)
                index.append(entry | {"offset": size, "length": len(raw)})
                parts.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield flush()
        if index:
            yield flush()

    return written(map_arrow(rows, run, MANIFEST), "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every record of the archives named in ``manifest`` (``READ``), by range reads alone."""
    spread = manifest.select("path").repartition(max(1, manifest.count()))

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = file_system(uri)
                with fs.open_input_file(path) as f:
                    members = directory(f)
                    lines = _at(f, data_start(f, members[INDEX]), members[INDEX][1]).decode().splitlines()
                    base, rows, size = data_start(f, members[RECORDS]), [], 0
                    for entry in map(json.loads, lines):
                        raw = gzip.decompress(_at(f, base + entry["offset"], entry["length"]))
                        rows.append(parse_record(raw))
                        size += len(raw)
                        if size > 4_000_000:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    return map_arrow(spread, run, READ)


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_TYPES)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=[x.split()[0] for x in READ.split(", ")])
