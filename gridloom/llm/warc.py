"""WARC archives: one gzip member per record, revisits for equal payloads, and a reader that salvages damaged files.

Records name their page in their id (``<urn:x-page:17>``); a revisit names the response it repeats
and keeps the payload's length and digest in its header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import publish, shared_folder

#: Compressed bytes after which a task begins the next file.
FILE_BYTES = 32_000_000
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MAGIC = b"\x1f\x8b\x08"
_PAGE = re.compile(r"<urn:x-page:(-?\d+|none)>")
_START = re.compile(rb"WARC/1\.[01]\r\n")


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, payload_digest: str, size: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, not compressed."""
    block = HTTP % size + (b"" if revisit else payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page)), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(size)), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.insert(2, ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    head = b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, size, response: the page whose response a row repeats, or its own id.

    Of equal payloads of at least ``min_bytes`` that with the largest page_id is the response; rows
    that repeat its id are responses as well, and null ids repeat the largest id there is.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    least = rows.where(F.col("size") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "top")
    joined = rows.join(least, "key", "left")
    return joined.select("page_id", "url", "payload", "size", F.coalesce("top", "page_id").alias("response"))


def write_archives(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", level: int = 4, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write rows of :func:`with_references` as ``*.warc.gz`` files below ``path``; a row (file, records) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            name = f"pages-{part:06d}-{seq:04d}.warc.gz"
            members = held
            publish(path, name, lambda out: [out.write(m) for m in members])
            return pa.RecordBatch.from_pydict({"file": [name], "records": [len(members)]})

        for batch in batches:
            for k, (page, url, _, n, response) in enumerate(zip(*(c.to_pylist() if j != 2 else c for j, c in enumerate(batch.columns)))):
                payload = batch.column(2)[k].as_py()
                raw = record(page, url, payload, digest(payload), n, response, page != response, date)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                held.append(packer.compress(raw) + packer.flush())
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    return rows.mapInArrow(run, "file string, records long")


# ------------------------------------------------------------------ reading


def parse(raw: bytes, start: int = 0) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record at ``start``; ValueError says what is wrong."""
    found = _START.match(raw, start)
    if not found:
        raise ValueError("no version line")
    end = raw.find(b"\r\n\r\n", found.end() - 2)
    if end < 0:
        raise ValueError("header cut off")
    headers = {}
    for line in raw[found.end() : end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        headers[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise ValueError("no length")
    at, size = end + 4, int(size)
    block = raw[at : at + size]
    if len(block) < size or raw[at + size : at + size + 4] != b"\r\n\r\n":
        raise ValueError("block cut off")
    want = headers.get("warc-block-digest")
    if want and want != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    return headers, block, at + size + 4


def _member(data: bytes, at: int, step: int = 1 << 15) -> tuple[bytes, int, str]:
    """(content, end, damage) of the gzip member at ``at``, fed piece by piece; what was inflated before damage is kept."""
    unpacker, out = zlib.decompressobj(31), []
    while not unpacker.eof and at < len(data):
        piece = data[at : at + step]
        before = unpacker.copy()
        try:
            out.append(unpacker.decompress(piece))
        except zlib.error as exc:
            for k in range(len(piece)):
                try:
                    out.append(before.decompress(piece[k : k + 1]))
                except zlib.error:
                    break
            return b"".join(out), at + k, f"member damaged: {exc}"
        at += len(piece)
    if not unpacker.eof:
        return b"".join(out), at, "member cut off"
    return b"".join(out), at - len(unpacker.unused_data), ""


def _records(raw: bytes) -> tuple[list[tuple[dict, bytes]], str]:
    """The whole records of a member's content, and what was wrong first; the next version line after a failed record is tried."""
    records, inner, why = [], 0, ""
    while 0 <= inner < len(raw):
        try:
            headers, block, inner = parse(raw, inner)
        except ValueError as exc:
            why = why or str(exc)
            inner = _find_start(raw, inner + 1)
        else:
            records.append((headers, block))
    return records, why


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, bytes, str]]:
    """(offset, length, headers, block, reason) of an archive's records and gaps, in order and without holes.

    Gaps have no headers and tell why their bytes were set aside.  After a failed check the next
    gzip member, or version line where records are not compressed, that holds a whole record is
    searched for.  A member with bad records or a damaged end keeps its good ones: they and a gap
    have the member's place, which reaches up to the next good one where its own end is not known.
    """
    at, gap, why = 0, None, ""
    held: list[tuple[dict, bytes]] = []

    def close(end: int):
        for headers, block in held:
            yield gap, end - gap, headers, block, ""
        yield gap, end - gap, None, b"", why

    while at < len(data):
        try:
            if data[at : at + 3] == MAGIC:
                raw, end, damage = _member(data, at)
                records, bad = _records(raw)
                if not records and (damage or bad):
                    raise ValueError(damage or bad)
            else:
                headers, block, end = parse(data, at)
                records, bad, damage = [(headers, block)], "", ""
        except ValueError as exc:
            if gap is None:
                gap, why = at, str(exc)
            ahead = [x for x in (data.find(MAGIC, at + 1), _find_start(data, at + 1)) if x >= 0]
            at = min(ahead, default=len(data))
            continue
        if gap is not None:
            yield from close(at)
            gap, held = None, []
        if damage:
            gap, why, held = at, damage, records
            ahead = [x for x in (data.find(MAGIC, at + 1), _find_start(data, end)) if x >= 0]
            at = min(ahead, default=len(data))
            continue
        for headers, block in records:
            yield at, end - at, headers, block, ""
        if bad:
            yield at, end - at, None, b"", f"record of the member damaged: {bad}"
        at = end
    if gap is not None:
        yield from close(len(data))


def _find_start(data: bytes, at: int) -> int:
    found = _START.search(data, at)
    return found.start() if found else -1


def page_of(name: str | None) -> int | None:
    found = _PAGE.fullmatch(name or "")
    return int(found[1]) if found and found[1] != "none" else None


READ = "file string, at long, bytes long, gap string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_archives(spark, path: str) -> DataFrame:
    """Records (gap null) and quarantined gaps (gap: the reason) of all archives below ``path``.

    A response whose payload does not have its own digest is a gap as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, uri in enumerate(batch.column(0).to_pylist()):
                rows: list[dict] = []
                for at, n, headers, block, why in salvage(batch.column(1)[k].as_py()):
                    row = {"file": uri.rsplit("/", 1)[1], "at": at, "bytes": n, "gap": why or None}
                    if headers is not None:
                        kind, named = headers.get("warc-type"), headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and named and digest(payload) != named:
                            row["gap"] = "payload digest differs"
                        else:
                            row |= {
                                "page_id": page_of(headers.get("warc-record-id")), "url": headers.get("warc-target-uri"), "record_type": kind, "payload": payload,
                                "payload_bytes": len(payload) if payload is not None else int(headers.get("x-payload-length", 0)),
                                "payload_digest": digest(payload) if payload is not None else named, "refers_to": page_of(headers.get("warc-refers-to")),
                            }
                    rows.append(row)
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist(rows, _READ)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")
    return files.mapInArrow(run, READ)


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_READ = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in READ.split(", ")])


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and read them back.

    A null html is an empty payload; an empty table gives no record.
    """
    spark = pages.sparkSession
    path, report = shared_folder(spark, "warc"), shared_folder(spark, "warc-files")
    write_archives(with_references(pages, min_bytes), path).write.parquet(report)
    if spark.read.schema("file string, records long").parquet(report).isEmpty():
        return spark.createDataFrame([], READ)
    return read_archives(spark, path)
