"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Archives lie in the shared folder, one gzip member per record, and are written and read through
pyarrow's file systems, so the folder may be on any store these know. Only archives named in the
manifest are read; what a lost task left behind is ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.session import shared_folder, written

LEAST_REVISIT = 100
PIECE = 1 << 20
#: Tasks that archives are dealt out to for reading; each may read several.
MOST_TASKS = 10_000
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "archive string, kind string, start long, end long, reason string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(text: str) -> int | None:
    number = text.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if re.fullmatch(r"-?\d+", number) else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit keeps the HTTP header, with the length of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Target-URI: {address}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict | str:
    """The fields of a whole record, or what is wrong with it."""
    if not VERSION.match(data):
        return "no version line"
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return "no end of header"
    head = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = head.get("content-length", "")
    if not length.isdigit() or len(data) - end - 4 < int(length):
        return "bad length"
    block = data[end + 4 : end + 4 + int(length)]
    if head.get("warc-block-digest", "") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        return "block digest differs"
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    revisit = head.get("warc-type") == "revisit"
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if not revisit and digest != hashlib.sha256(payload).hexdigest():
        return "payload digest differs"
    return {
        "page_id": _page(head.get("warc-record-id", "")), "url": head.get("warc-target-uri"), "record_type": head.get("warc-type"), "payload_bytes": int(size[1]) if size else len(payload),
        "payload_digest": digest, "refers_to": _page(head.get("warc-refers-to", "")), "payload": None if revisit else payload, "size": end + 4 + int(length),
    }


class _Window:
    """A file read forward in pieces, of which only what is from the current position on is held."""

    def __init__(self, file):
        self.file, self.at, self.data, self.ended = file, 0, b"", False

    def more(self) -> bool:
        piece = b"" if self.ended else self.file.read(PIECE)
        self.ended = self.ended or not piece
        self.data += piece
        return bool(piece)

    def skip(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n


def _member(window: _Window) -> tuple[bytes, int] | None:
    """The contents and the length of the gzip member here; none if it fails its checks or is cut off."""
    unpack, out, fed = zlib.decompressobj(31), [], 0
    try:
        while not unpack.eof:
            if fed == len(window.data) and not window.more():
                return None
            piece = window.data[fed : fed + PIECE]
            out.append(unpack.decompress(piece))
            fed += len(piece)
    except zlib.error:
        return None
    return b"".join(out), fed - len(unpack.unused_data)


def _plain(window: _Window) -> tuple[dict, int] | None:
    """The record at a version line and its length."""
    while b"\r\n\r\n" not in window.data and len(window.data) < PIECE and window.more():
        pass
    head = window.data[: window.data.find(b"\r\n\r\n") + 4]
    length = re.search(rb"(?i)\r\ncontent-length: *(\d{1,12})\r\n", head)
    if not length:
        return None
    while len(window.data) < len(head) + int(length[1]) + 4 and window.more():
        pass
    found = parsed(window.data[: len(head) + int(length[1])])
    return None if isinstance(found, str) else (found, found["size"] + (4 if window.data[found["size"] :][:4] == b"\r\n\r\n" else 0))


def salvaged(file) -> Iterator[dict]:
    """Records of one archive, and a gap for each run of bytes that belongs to no valid record.

    Where a member or record fails its checks, the search goes on from the next byte for a
    member or a version line that passes; all bytes between are quarantined. Memory: one record and a piece.
    """
    window, bad, why = _Window(file), None, ""
    while window.data or window.more():
        while len(window.data) < 10 and window.more():
            pass
        found, reason = None, "no record here"
        if window.data.startswith(MAGIC):
            member = _member(window)
            record = parsed(member[0]) if member else "member fails its checks"
            found, reason = (None, record) if isinstance(record, str) else ((record, member[1]), "")
        elif VERSION.match(window.data):
            found = _plain(window)
            reason = "record fails its checks"
        if found:
            if bad is not None:
                yield {"kind": "gap", "start": bad, "end": window.at, "reason": why}
                bad = None
            yield {"kind": "record", "start": window.at, "end": window.at + found[1], **found[0]}
            window.skip(found[1])
            continue
        if bad is None:
            bad, why = window.at, reason
        while True:
            next_at = [at for at in (window.data.find(MAGIC, 1), window.data.find(b"WARC/1.", 1)) if at > 0]
            if next_at:
                window.skip(min(next_at))
                break
            window.skip(max(0, len(window.data) - 9))
            if not window.more():
                window.skip(len(window.data))
                break
    if bad is not None:
        yield {"kind": "gap", "start": bad, "end": window.at, "reason": why}


def _writer(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        name, count, out = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for page_id, url, html, digest, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "revisit"))):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(pack.compress(record_bytes(page_id, url, html or b"", digest, refers_to, revisit)) + pack.flush())
                count += 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([count])], names=["archive", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``) as archives, one per partition; the manifest: ``archive``, ``records``.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest id (nulls last) is a response, the
    others revisit it. Repeated rows of that id are all responses. A null page is an empty payload.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/clickloom/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    # file:/x and file:///x name one folder; pyarrow knows the second form
    folder = re.sub(r"^file:/+", "file:///", folder)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = F.octet_length("html") >= least
    repeated = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    joined = rows.join(repeated.select(F.col("digest").alias("same"), "first"), F.col("digest") == F.col("same"), "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    joined = joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return written(joined.mapInArrow(_writer(folder), "archive string, records long"))


def _reader(payloads: bool) -> Callable:
    names = [field.split()[0] for field in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                with store.open_input_stream(path, compression=None) as file:
                    held, size = [], 0
                    for row in salvaged(file):
                        row = row if payloads else {**row, "payload": None}
                        held.append({**row, "archive": archive})
                        size += 500 + len(row.get("payload") or b"")
                        if size > PIECE:
                            yield _batch(held, names)
                            held, size = [], 0
                    if held:
                        yield _batch(held, names)

    return run


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"start": pa.int64(), "end": pa.int64(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.record_batch([pa.array([row.get(name) for row in rows], kinds.get(name, pa.string())) for name in names], names=names)


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives of a manifest: ``kind`` is record or gap, ``start`` and ``end`` are bytes of the file.

    Each record's digests are checked against its bytes. A revisit has no payload of its own; its length and digest are those of the payload it repeats.
    """
    # an archive is much work for so small a row, so that rows must not be put together by their size
    tasks = min(manifest.count(), MOST_TASKS)
    return manifest.select("archive").repartition(max(1, tasks), "archive").mapInArrow(_reader(payloads), RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), payloads=False)
    return records.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS bytes FROM pages),
hashed AS (SELECT page_id, bytes, sha256(html) AS digest FROM sized),
firsts AS (SELECT *, CASE WHEN bytes >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM hashed)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts
"""
