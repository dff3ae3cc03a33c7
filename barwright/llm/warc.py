"""WARC archives: writing pages as whole-file gzip streams, and normalising these to one gzip member per record.

A capture tool may leave an archive as a single gzip stream, in which no record can be read without inflating all
before it. The normaliser inflates each such stream once, from front to end, writes every record again as a gzip
member of its own, and a sidecar ``*.idx`` with each member's offset and length; then any record is one seek away.
While it rewrites, it turns records whose payload an earlier page has into revisits.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh_folder, materialise, partition_id
from .files import drop_folder, make_folder, open_store

#: Bytes of records, and records, after which a writer starts another archive.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 100_000
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def header_text(value: str | None) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else "%" + c.encode("utf-8", "replace").hex() for c in value or "")


def build(headers: list[tuple[str, str]], http: bytes, payload: bytes) -> bytes:
    block = http + payload
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode("utf-8", "replace") for k, v in headers), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def http_head(length: int) -> bytes:
    return CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % length]) + CRLF * 2


def response(page_id: int | None, url: str | None, payload: bytes, sha: str) -> bytes:
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", header_text(url)),
        ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http;msgtype=response"),
    ]
    return build(headers, http_head(len(payload)), payload)


def as_revisit(head: dict[str, str], block: bytes, refers_to: int | None) -> bytes:
    """A response record as a revisit: its HTTP head stays, its payload goes."""
    headers = [(k, v) for k, v in head.items() if k not in ("WARC-Type", "Content-Length")]
    headers = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *headers, ("WARC-Refers-To", record_id(refers_to))]
    return build(headers, block[: block.index(CRLF * 2) + 4], b"")


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


class Records:
    """Records of an inflated WARC stream, one after the other; holds one record and one chunk at a time."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.buffer = chunks, bytearray()

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is not None:
            self.buffer += chunk
        return chunk is not None

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        """(headers, whole record, block)."""
        while True:
            at = 0
            while (end := self.buffer.find(CRLF * 2, max(0, at - 3))) < 0:
                at = len(self.buffer)
                if not self._more():
                    if self.buffer.strip():
                        raise ValueError("a WARC record is cut off")
                    return
            head = parse_head(bytes(self.buffer[:end]))
            size = end + 4 + int(head["Content-Length"]) + 4
            while len(self.buffer) < size:
                if not self._more():
                    raise ValueError("a WARC record is cut off")
            whole = bytes(self.buffer[:size])
            del self.buffer[:size]
            yield head, whole, whole[end + 4 : -4]


def inflate(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Chunks of a gzip file, be it one stream or several members."""
    z = zlib.decompressobj(31)
    while raw := stream.read(size):
        while raw:
            yield z.decompress(raw)
            raw = z.unused_data
            if raw or z.eof:
                z = zlib.decompressobj(31)


def member(record: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


CAPTURED = "archive string, place long, page_id long, sha1 string, payload_bytes long"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one response record per page into archives that are a single gzip stream each.

    Returns what was captured: (archive, place in it, page_id, sha1, payload_bytes). Payloads are the pages in UTF-8;
    null is empty. Each task writes archives of its own under new names.
    """
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        out = z = None
        size = place = 0
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            urls, pages_ = batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for i, url, html in zip(ids, urls, pages_):
                if out is None:
                    name = f"{partition_id():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, z, size, place = store.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                payload = html.as_py() or b""
                sha = digest(payload)
                record = response(i, url, payload, sha)
                out.write(z.compress(record))
                rows.append({"archive": f"{folder}/{name}", "place": place, "page_id": i, "sha1": sha, "payload_bytes": len(payload)})
                size, place = size + len(record), place + 1
                if size >= archive_bytes or place >= ARCHIVE_RECORDS:
                    out.write(z.flush())
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("archive", pa.string()), ("place", pa.int64()), ("page_id", pa.int64()), ("sha1", pa.string()), ("payload_bytes", pa.int64())]))
        if out is not None:
            out.write(z.flush())
            out.close()

    source = pages.select(column(pages, id_col).cast("long").alias("i"), column(pages, url_col).cast("string").alias("u"), column(pages, html_col).cast("string").alias("h"))
    return materialise(source.mapInArrow(run, CAPTURED), "captured")


def first_captures(captured: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(archive, refers: array<struct<place, page_id>>): per archive which of its records revisit which page.

    Of captures with equal payloads of at least ``least_bytes`` bytes that with the smallest page id stays a response
    (null ids last; of equal ids one). Payloads are equal if digest and length are. The first one per payload is a
    partial aggregate, so a payload that a third of all pages share is no hot group; the join reads two written tables,
    so that its rows can be split.
    """
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "place")
    first = captured.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1", "payload_bytes").agg(F.min(key).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = materialise(first.select("sha1", "payload_bytes", F.col("f.page_id").alias("first_page"), F.col("f.archive").alias("first_archive"), F.col("f.place").alias("first_place")), "first-captures")
    again = captured.join(first, ["sha1", "payload_bytes"]).where("archive <> first_archive OR place <> first_place")
    per = again.groupBy("archive").agg(F.collect_list(F.struct("place", F.col("first_page").alias("page_id"))).alias("refers"))  # bounded by an archive
    archives = captured.select(F.col("archive").alias("archive_")).distinct()
    return archives.join(per, F.col("archive_") == F.col("archive"), "left").select(F.col("archive_").alias("archive"), "refers")


def spread(df: DataFrame) -> DataFrame:
    """A written table of few rows that each are much work, dealt out one or a few to a task."""
    return df.repartition(max(1, min(10_000, df.count())))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (archive, refers) with a gzip member per record and a sidecar index; returns (path, records).

    ``path`` is without the endings ``.warc.gz`` and ``.idx``. An index line is JSON: id, offset, length.
    """
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                refers = {r["place"]: r["page_id"] for r in row["refers"] or ()}
                store, source = open_store(row["archive"])
                target, root = open_store(folder)
                name = uuid.uuid4().hex
                at = n = 0
                with store.open_input_stream(source, compression=None) as raw, target.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out, target.open_output_stream(f"{root}/{name}.idx") as index:
                    for head, whole, block in Records(inflate(raw)):
                        packed = member(as_revisit(head, block, refers[n]) if n in refers else whole)
                        out.write(packed)
                        index.write(json.dumps({"id": head["WARC-Record-ID"], "offset": at, "length": len(packed)}).encode() + b"\n")
                        at, n = at + len(packed), n + 1
                yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n}], schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return materialise(spread(materialise(archives, "archives")).mapInArrow(run, "path string, records long"), "normalised")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of normalised archives (path), each record read at its index entry.

    A response's length and digest are those of the payload found; a revisit's length is in its HTTP head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = open_store(path)
                with store.open_input_stream(f"{name}.idx") as f:
                    entries = [json.loads(line) for line in io.BytesIO(f.read())]
                rows = []
                with store.open_input_file(f"{name}.warc.gz") as f:
                    for e in entries:
                        f.seek(e["offset"])
                        whole = zlib.decompress(f.read(e["length"]), 31)
                        cut = whole.index(CRLF * 2)
                        head, block = parse_head(whole[:cut]), whole[cut + 4 : -4]
                        http = block.index(CRLF * 2)
                        payload, kind = block[http + 4 :], head["WARC-Type"]
                        fresh = kind == "response"
                        rows.append({
                            "page_id": page_of(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"),
                            "payload_bytes": len(payload) if fresh else int(parse_head(block[:http])["Content-Length"]),
                            "payload_digest": digest(payload) if fresh else head["WARC-Payload-Digest"].removeprefix("sha1:"),
                            "record_type": kind, "refers_to": None if fresh else page_of(head["WARC-Refers-To"]),
                        })
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return spread(archives.select("path")).mapInArrow(run, READ)


def archive_pages(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, normalise these, and read them back: one row per page.

    Empty table: empty result. Null urls are read back as empty; repeated rows stay repeated.
    """
    spark = pages.sparkSession
    raw = fresh_folder(spark, "warc-streams")
    captured = write_archives(pages, raw, archive_bytes=archive_bytes)
    archives = normalise(first_captures(captured, least_bytes), fresh_folder(spark, "warc"))
    drop_folder(raw)
    return read_archives(archives)
