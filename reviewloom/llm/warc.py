"""WARC archives with a two-level capture index.

Writing: pages are ordered by task, each task writes gzip members (one for each record)
to an archive of its own in the shared folder, under a new name for each attempt; only the
archives named in the stored list of captures count, so that a lost executor or a repeated
task leaves at most an unused file. A page whose payload equals that of a page with a
smaller id becomes a revisit record.

Index: captures are sorted by the key "reversed host)path" and cut into compressed
blocks of ``BLOCK_LINES`` lines; the sparse directory holds the first key of each block
with its file, offset and length. A lookup is a binary search in the directory, one block
read, a binary search in its lines, and a range read of the record.

Rows: a null html is an empty payload; a null url has the key "-" and no target; rows
that repeat the smallest page_id of a payload are all responses; null ids come after all
others (a payload known only from null ids is a response). Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.common import byte_column
from reviewloom.storage import materialise, scratch_path

BLOCK_LINES = 1_000
DATE = "2000-01-01T00:00:00Z"  # pages carry no date; a fixed one keeps archives reproducible


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system of a folder that driver and executors share (local path or URI)."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def url_key(url: str | None) -> str:
    """Sort key: host labels in reverse, then path and query."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").rstrip(".")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return "-" + " ".join(url.split()).replace(" ", "%20")
    query = f"?{parts.query}" if parts.query else ""
    key = ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + query
    return "".join(f"%{ord(c):02X}" if c.isspace() else c for c in key)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member with a response record, or a revisit record without payload."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}")
    revisit = refers_to is not None
    headers = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", f"WARC-Page-ID: {json.dumps(page_id)}",
    ]
    if url:
        headers.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    if revisit:
        headers += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {json.dumps(refers_to)}"]
    block = b"" if revisit else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    headers += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(block)}"]
    return gzip.compress("\r\n".join(headers).encode() + b"\r\n\r\n" + http + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record of wrong length")
    return headers, block.partition(b"\r\n\r\n")[2]


def first_pages(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``digest``, ``first``: smallest page_id of each payload that occurs more than once."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    return own.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write all pages; returns the stored list of captures ``key, page_id, archive, offset, length``."""
    kind = pages.schema["page_id"].dataType
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    # Equal payloads meet by digest; a page that occurs in a third of the rows is split by AQE.
    joined = keyed.join(first_pages(pages, least_bytes), "digest", "left").select("page_id", "url", "html", "first")

    def work(batches):
        system, path = opened(folder)
        archive = f"pages-{uuid.uuid4().hex}.warc.gz"
        sink, offset = None, 0
        for batch in batches:
            out = {k: [] for k in ("key", "page_id", "offset", "length")}
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3)]
            for page_id, url, first, payload in zip(*columns, byte_column(batch, "html"), strict=True):
                if sink is None:
                    sink = system.open_output_stream(f"{path}/{archive}", compression=None)
                refers_to = None if first is None or first == page_id else first
                member = record(page_id, url, payload, payload_digest(payload), refers_to)
                sink.write(member)
                for k, v in zip(out, (url_key(url), page_id, offset, len(member)), strict=True):
                    out[k].append(v)
                offset += len(member)
            ids = pa.array(out["page_id"], batch.schema.field(0).type)
            arrays = [pa.array(out["key"], pa.string()), ids, pa.array([archive] * len(out["key"]), pa.string()), pa.array(out["offset"], pa.int64()), pa.array(out["length"], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "page_id", "archive", "offset", "length"])
        if sink is not None:
            sink.close()

    captures = joined.mapInArrow(work, f"key string, page_id {kind.simpleString()}, archive string, offset long, length long")
    return materialise(captures, "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write index files; returns the directory ``first_key, index, offset, length, lines`` (one row for each block).

    Captures are range partitioned by key, archive and offset, so that one url captured very
    often is still cut into several parts.
    """

    def work(batches):
        system, path = opened(folder)
        name, sink, offset = f"index-{uuid.uuid4().hex}.cdx.gz", None, 0
        lines: list[str] = []
        rows: list[tuple] = []

        def flush():
            nonlocal sink, offset
            if sink is None:
                sink = system.open_output_stream(f"{path}/{name}", compression=None)
            block = gzip.compress("\n".join(lines).encode(), compresslevel=6, mtime=0)
            sink.write(block)
            rows.append((lines[0].split(" ", 1)[0], name, offset, len(block), len(lines)))
            offset += len(block)
            lines.clear()

        for batch in batches:
            for key, page_id, archive, at, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lines.append(f"{key} {json.dumps(page_id)} {archive} {at} {length}")
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if sink is not None:
            sink.close()
            names = ["first_key", "index", "offset", "length", "lines"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    order = ["key", "archive", "offset"]
    ranged = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    directory = ranged.mapInArrow(work, "first_key string, index string, offset long, length long, lines long")
    return materialise(directory, "index-directory")


def read_range(folder: str, name: str, offset: int, length: int) -> bytes:
    system, path = opened(folder)
    with system.open_input_file(f"{path}/{name}") as source:
        source.seek(offset)
        return source.read(length)


def block_lines_of(folder: str, index: str, offset: int, length: int) -> list[list[str]]:
    text = gzip.decompress(read_range(folder, index, offset, length)).decode()
    return [line.split(" ") for line in text.split("\n")]


def lookup(directory: list[tuple], folder: str, url: str) -> list[tuple[dict[str, str], bytes]]:
    """Records of one url. ``directory``: rows of the sparse directory in order of first key."""
    key = url_key(url)
    firsts = [r[0] for r in directory]
    out = []
    # The key may start in the block before the first block that begins at or after it.
    for row in directory[max(0, bisect.bisect_left(firsts, key) - 1) : bisect.bisect_right(firsts, key)]:
        lines = block_lines_of(folder, *row[1:4])
        at = bisect.bisect_left(lines, key, key=lambda x: x[0])
        while at < len(lines) and lines[at][0] == key:
            out.append(parse(read_range(folder, lines[at][2], int(lines[at][3]), int(lines[at][4]))))
            at += 1
    return out


def read_archives(directory: DataFrame, folder: str, kind: str) -> DataFrame:
    """Read every record back through the index: blocks by the directory, records by range reads.

    Captures are regrouped by archive and place, so that every archive is read from
    front to back. Returns ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``.
    """

    def entries(batches):
        for batch in batches:
            for _, index, offset, length, _ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lines = block_lines_of(folder, index, offset, length)
                arrays = [pa.array([x[2] for x in lines]), pa.array([int(x[3]) for x in lines]), pa.array([int(x[4]) for x in lines])]
                yield pa.RecordBatch.from_arrays(arrays, names=["archive", "offset", "length"])

    def records(batches):
        system, path = opened(folder)
        source, name = None, None
        try:
            for batch in batches:
                rows = []
                for archive, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if archive != name:
                        if source is not None:
                            source.close()
                        source, name = system.open_input_file(f"{path}/{archive}"), archive
                    source.seek(offset)
                    headers, payload = parse(source.read(length))
                    revisit = headers["WARC-Type"] == "revisit"
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and (payload_digest(payload) != digest or len(payload) != int(headers["WARC-Payload-Length"])):
                        raise ValueError(f"damaged record in {archive} at {offset}")
                    rows.append((
                        json.loads(headers["WARC-Page-ID"]), headers.get("WARC-Target-URI"), int(headers["WARC-Payload-Length"]), digest,
                        headers["WARC-Type"], json.loads(headers["WARC-Refers-To-Page"]) if revisit else None, None if revisit else payload,
                    ))
                    if len(rows) == 256:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)
        finally:
            if source is not None:
                source.close()

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    types = [id_type, pa.string(), pa.int64(), pa.string(), pa.string(), id_type, pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    found = directory.select("first_key", "index", "offset", "length", "lines").mapInArrow(entries, "archive string, offset long, length long")
    ordered = found.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(records, f"page_id {kind}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, payload binary")


def write_collection(spark: SparkSession, pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> tuple[str, DataFrame]:
    """Archives and index of all pages in a shared folder: (folder, sparse directory)."""
    folder = folder or scratch_path(spark, "warc")
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    return folder, write_index(write_archives(pages, folder, least_bytes), folder)
