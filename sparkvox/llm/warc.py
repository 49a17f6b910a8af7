"""WARC archives: writer, normaliser of monolithic gzip, reader by index.

Pages become response records, or revisit records where a longer payload has
been seen before. Archives come as one gzip stream each, which can only be
read from the start. The normaliser inflates such a stream once, in small
pieces, writes every record as a gzip member of its own, and next to the
archive an index of offsets, by which the reader fetches single records.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvox.llm import files
from sparkvox.llm.common import filled, written
from sparkvox.session import ship_package

#: Payload bytes of an archive, about (a record is never split).
ARCHIVE_BYTES = 16 << 20
#: Shorter payloads are always written in full.
REVISIT_BYTES = 1000
PIECE = 1 << 16
GZIP = 31  # zlib's window setting for gzip streams
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    number = name[len("<urn:page:"):-1] if name else ""
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP head only, and its payload's digest and length."""
    block = HTTP if revisit else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}",
            f"WARC-Date: {DATE}"]
    if url is not None:
        # Line ends and other control characters would break the head.
        clean = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url)
        head.append(f"WARC-Target-URI: {clean}")
    head += [f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def head_of(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, holding one record at a time."""
    buffer, need, searched = bytearray(), 0, 0
    for piece in pieces:
        buffer += piece
        while buffer:
            if not need:
                end = buffer.find(b"\r\n\r\n", max(0, searched - 3))
                if end < 0:
                    searched = len(buffer)
                    break
                need = end + 8 + int(head_of(bytes(buffer[:end]))["content-length"])
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = searched = 0
    if buffer:
        raise ValueError("the archive ends inside a record")


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """A gzip file's content piece by piece, whether one member or many."""
    engine = zlib.decompressobj(GZIP)
    while data := read(PIECE):
        while data:
            out = engine.decompress(data, PIECE * 4)
            if out:
                yield out
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine = engine.unused_data, zlib.decompressobj(GZIP)


def normalise(read: Callable[[int], bytes], write: Callable[[bytes], object], level: int = 4) -> list[dict]:
    """Rewrites a gzip archive with a member per record. Gives the index: id,
    type, offset and length of each record's member."""
    index, offset = [], 0
    for raw in records_of(inflated(read)):
        engine = zlib.compressobj(level, zlib.DEFLATED, GZIP)
        member = engine.compress(raw) + engine.flush()
        write(member)
        head = head_of(raw[:raw.index(b"\r\n\r\n")])
        index.append({"id": head["warc-record-id"], "type": head["warc-type"], "offset": offset, "length": len(member)})
        offset += len(member)
    return index


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page id, payload bytes, payload digest, type, page referred to. What a
    response says of its payload is checked against the payload."""
    end = raw.index(b"\r\n\r\n")
    head = head_of(raw[:end])
    digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
    if head["warc-type"] == "response":
        block = raw[end + 4:end + 4 + int(head["content-length"])]
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record {head['warc-record-id']} does not hold what it says")
    return page_of(head["warc-record-id"]), size, digest, head["warc-type"], page_of(head.get("warc-refers-to"))


def _writes(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            name, size, count = files.new_name(f"pages-{part:06d}", ".warc.gz"), 0, 0
            engine = zlib.compressobj(1, zlib.DEFLATED, GZIP)
            with files.creating(folder, name) as out:
                while row is not None and (not count or size < archive_bytes):
                    page_id, url, html, refers_to, revisit = row
                    payload = (html or "").encode()
                    out.write(engine.compress(record(page_id, url, payload, refers_to, revisit)))
                    size, count, row = size + len(payload), count + 1, next(rows, None)
                out.write(engine.flush())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["name", "records"])

    return run


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Writes a record per row of ``pages`` into archives of one gzip stream
    each. Gives their folder and table (name, records).

    A null html is an empty payload, a null url is left out. Of equal payloads
    (SHA-256 and length) of at least REVISIT_BYTES, rows with the largest id
    are responses, all others revisits of it; shorter ones are responses.
    Only digests are shuffled; a page moves only if the table of repeated
    payloads is too large to broadcast."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = files.shared_folder(spark, "archives")
    html = filled(F.col(html_col))
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"),
                       F.unhex(F.sha2(html, 256)).alias("sha"), F.octet_length(html).alias("size"))
    repeated = (own.where(F.col("size") >= REVISIT_BYTES).groupBy("sha", "size")
                .agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "size", "first"))
    joined = own.join(written(repeated, "repeated_payloads"), ["sha", "size"], "left")
    revisit = F.coalesce(F.col("first") != F.coalesce("id", F.lit(-1)), F.lit(False))
    rows = joined.select("id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return folder, written(rows.mapInArrow(_writes(folder, archive_bytes), "name string, records long"), "archives")


def _normalises(source: str, target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for old in batch.column(0).to_pylist():
                name = files.new_name(old.partition(".")[0], ".warc.gz")
                with files.opening(source, old) as read, files.creating(target, name) as out:
                    index = normalise(read.read, out.write)
                with files.creating(target, name + ".index") as out:
                    out.write("".join(json.dumps(x) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64())],
                                                 names=["name", "records"])

    return run


def _spread(table: DataFrame) -> DataFrame:
    """Names dealt out, so that each archive is a task's work."""
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.select("name").repartition(n)


def normalise_archives(folder: str, archives: DataFrame) -> tuple[str, DataFrame]:
    """Normalises each archive of the table; gives the new folder and table.
    Beside each archive lies its index, ``<name>.index``, a JSON line per record."""
    target = files.shared_folder(archives.sparkSession, "normalised")
    return target, written(_spread(archives).mapInArrow(_normalises(folder, target), "name string, records long"), "normalised")


def _reads(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.opening(folder, name + ".index") as source:
                    index = [json.loads(x) for x in source.read().decode().splitlines()]
                found = []
                with files.opening(folder, name, seekable=True) as source:
                    for entry in index:
                        source.seek(entry["offset"])
                        found.append(parsed(zlib.decompress(source.read(entry["length"]), GZIP)))
                columns = [list(x) for x in zip(*found, strict=True)] or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_archives(folder: str, archives: DataFrame) -> DataFrame:
    """One row per record, fetched by the index."""
    return _spread(archives).mapInArrow(
        _reads(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY html)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN g USING (html)
"""
