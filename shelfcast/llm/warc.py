"""WARC archives: one gzip member per record, written and read back record by record.

Pages with equal payloads (SHA-1 and length) of at least ``min_bytes`` share
one response, that of the largest page_id; the others are revisit records
that refer to it.  Each task streams its rows into archives of bounded size
in the folder given; a manifest of the finished ones, committed by Spark's own
writer, names the archives that count, so a task's lost attempts leave no
record behind.  The reader inflates a stream of bytes step by step, frames
each record by its content length and verifies block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stage
from shelfcast.session import shared_dir

#: Bytes after which an archive is closed, and bytes read at once.
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 16
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-page:"

MANIFEST = "path string, records long"
READ = ("page_id long, target_uri string, record_type string, payload binary, payload_bytes long, "
        "payload_digest string, refers_to long, path string, offset long")


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def open_fs(uri: str):
    """File system and path of a URI that every executor can reach (a bare path is a mounted folder)."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One record as a gzip member; a revisit (``refers_to`` given) has the HTTP header as its block and no payload."""
    name = lambda i: f"<{RECORD}{'' if i is None else i}>"
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
             ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return z.compress(text.encode("utf-8", "surrogatepass")) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class Damaged(ValueError):
    """An archive that breaks its format or a digest."""


def members(read):
    """(offset, inflated bytes of one gzip member) in order; ``read(n)`` gives the next bytes, empty at the end."""
    held, offset = read(CHUNK), 0
    while held:
        z, out, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not held:
                raise Damaged(f"member at {offset} ends early")
            try:
                out.append(z.decompress(held))
            except zlib.error as e:
                raise Damaged(f"member at {offset}: {e}") from e
            used += len(held)
            held = z.unused_data if z.eof else read(CHUNK)
        used -= len(held)
        yield offset, b"".join(out)
        offset += used
        held = held or read(CHUNK)


def parse(data: bytes, offset: int = 0) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header (names in lower case) and payload of one member, framed and verified."""
    def header(lines: bytes) -> dict[str, str]:
        pairs = (x.partition(b":") for x in lines.split(b"\r\n")[1:])
        return {k.decode().strip().lower(): v.decode("utf-8", "surrogatepass").strip() for k, _, v in pairs}

    top, _, rest = data.partition(b"\r\n\r\n")
    if not top.startswith(b"WARC/1."):
        raise Damaged(f"no record at {offset}")
    warc = header(top)
    n = int(warc.get("content-length", -1))
    block, tail = rest[:n], rest[n:]
    if n < 0 or len(block) != n or tail != b"\r\n\r\n":
        raise Damaged(f"record at {offset} isn't as long as it says")
    if warc.get("warc-block-digest", "") != f"sha1:{digest(block)}":
        raise Damaged(f"record at {offset} has another block digest")
    head, _, payload = block.partition(b"\r\n\r\n")
    http = header(head)
    if warc["warc-type"] == "response" and (warc.get("warc-payload-digest") != f"sha1:{digest(payload)}" or int(http["content-length"]) != len(payload)):
        raise Damaged(f"record at {offset} has another payload digest or length")
    return warc, http, payload


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html, refers_to)``: refers_to is the largest page_id of an equal payload, null for a response."""
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
            .withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html")))
    shared = (rows.filter(F.col("size") >= min_bytes).groupBy("sha", "size")
              .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return (rows.join(shared, ["sha", "size"], "left")
            .withColumn("refers_to", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")))
            .select("page_id", "url", "html", "refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` under ``folder``; the manifest ``(path, records)``.

    A null html is the empty payload, a null url has no target URI.  A null
    page_id refers to the largest id of its payload, or is a response if there is
    none.  Repeated rows with a payload's largest id are all responses.  Other
    columns are ignored; an empty table writes nothing.
    """
    def run(batches):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, path, size, n = None, "", 0, 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    path, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                data = record(row[0], row[1], row[2].encode("utf-8", "surrogatepass"), row[3])
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path.rpartition("/")[2]], "records": pa.array([n], pa.int64())})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path.rpartition("/")[2]], "records": pa.array([n], pa.int64())})

    return stage(plan_records(pages, min_bytes).mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives that ``manifest`` names, in whole; ``payloads=False`` leaves payload null.

    payload_bytes and payload_digest are those of the full payload, for
    revisits as their headers state them.
    """
    def run(batches):
        fs, base = open_fs(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(f"{base}/{path}", compression=None) as f:
                    for offset, data in members(f.read):
                        warc, http, payload = parse(data, offset)
                        number = lambda x: int(x[1 + len(RECORD):-1]) if x and x != f"<{RECORD}>" else None
                        revisit = warc["warc-type"] == "revisit"
                        rows.append((number(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"],
                                     payload if payloads and not revisit else None, int(http["content-length"]),
                                     warc["warc-payload-digest"].removeprefix("sha1:"), number(warc.get("warc-refers-to")), path, offset))
                        held += len(payload) + 200
                        if held > ARCHIVE_BYTES // 4:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    spread = manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4))
    return spread.mapInArrow(run, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def round_trip(pages: DataFrame, min_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Archives of ``pages`` in the shared folder, read back."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, min_bytes), folder, payloads)
