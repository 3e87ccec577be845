"""WARC archives: whole-file gzip streams made into one member a record, with an offset index.

Archives as crawlers leave them may be one gzip stream from end to end, of which no record can
be read by itself.  ``normalise`` inflates such a file once, front to back, writes every
record as a gzip member of its own, and beside it an index file with a line for each record:
offset, length and what the header says.  ``read_records`` then reads any record by itself.

Files are opened through ``pyarrow.fs`` in a folder that all executors share.  A task writes
under a name of its own attempt, and only the manifest of finished tasks names files, so an
attempt that is lost or repeated is never read.  An archive is closed at ``archive_bytes``; a
task holds one record and one buffer, not a file.

Defined cases: a null payload is empty; a null url is left out; characters of a url that a
header cannot hold are percent-encoded; ids are written as JSON, so null and text ids come back
as they were.  Payloads under 100 bytes are always responses.  Among equal payloads every row
with the smallest id is a response (ids that are null count as largest; if all are null, all
are responses) and the others are revisits of it.  No rows give no archives.  A file that ends
inside a record raises.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import keep, new_folder, small

REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 18
# Bytes of payloads that a task reads back before it passes them on, unless one alone has more.
READ_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, n_records long, n_bytes long"
INDEX = (
    "path string, offset long, length long, record_id string, record_type string, "
    "page string, payload_bytes long, payload_digest string, refers_to string"
)


# ---- records ----------------------------------------------------------------

def record_id(page: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, 'page:' + page).urn}>"


def _record(kind: str, headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines += [f"{name}: {value}" for name, value in headers.items() if value is not None]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page: str, unique: str, url: str | None, body: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit without, whose header tells of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    headers = {
        "WARC-Record-ID": record_id(page) if page != "null" else f"<{uuid.uuid5(uuid.NAMESPACE_URL, unique).urn}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": PROFILE if refers_to else None,
        "WARC-Refers-To": record_id(refers_to) if refers_to else None,
        "X-Page": page,
        "X-Refers-To-Page": refers_to,
        "X-Payload-Length": str(len(body)),
        "Content-Type": "application/http; msgtype=response",
    }
    return _record("revisit" if refers_to else "response", headers, http.encode() + (b"" if refers_to else body))


def parse_headers(head: bytes) -> dict[str, str]:
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines if line)}


def read_records_of(chunks: Iterator[bytes], name: str) -> Iterator[bytes]:
    """Records, header and block, of an inflated stream."""
    buffer = bytearray()

    def fill(size: int) -> bool:
        while len(buffer) < size:
            more = next(chunks, None)
            if more is None:
                return False
            buffer.extend(more)
        return True

    while fill(1):
        end, searched = -1, 0
        while end < 0:
            end = buffer.find(b"\r\n\r\n", max(0, searched - 3))
            searched = len(buffer)
            if end < 0 and not fill(searched + 1):
                raise ValueError(f"{name} ends inside a header")
        size = end + 4 + int(parse_headers(bytes(buffer[:end]))["content-length"])
        if not fill(size + 4):
            raise ValueError(f"{name} ends inside a record")
        yield bytes(buffer[:size])
        del buffer[: size + 4]


def inflate(source, name: str) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, a chunk at a time."""
    stream, data, ended = zlib.decompressobj(31), b"", True
    while True:
        data = data or source.read(CHUNK)
        if not data:
            if not ended:
                raise ValueError(f"{name}: the gzip stream is cut off")
            return
        out = stream.decompress(data, CHUNK)
        ended = stream.eof
        data = stream.unused_data if stream.eof else stream.unconsumed_tail
        if stream.eof:
            stream = zlib.decompressobj(31)
        if out:
            yield out


# ---- jobs --------------------------------------------------------------------

def plan_records(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """Every page with its digest and, for a revisit, the page it refers to."""
    body = F.coalesce(F.col(f"`{body_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    # One narrow line for each repeated payload, added up before it is shuffled.
    first = keep(
        rows.where(F.octet_length("body") >= REVISIT_BYTES)
        .groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL").select("digest", "first"),
        "payloads",
    )
    refers = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(small(first), "digest", "left").withColumn("refers_to", refers).drop("first")


def write_archives(records: DataFrame, folder: str, date: str, archive_bytes: int) -> DataFrame:
    """Archives of one gzip stream each; returns their manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, attempt, number, seen = context.partitionId(), context.taskAttemptId(), 0, 0
        out = None

        def close() -> pa.RecordBatch:
            target.write(gzip.flush())
            target.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [count], "n_bytes": [size]})

        for batch in batches:
            for row in zip(*(batch.column(name) for name in ("page", "url", "body", "digest", "refers_to")), strict=True):
                page, url, body, digest, refers_to = (value.as_py() for value in row)
                if out is None:
                    path = f"{root}/raw-{task:06d}-{number:04d}-{attempt}.warc.gz"
                    target, gzip = store.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                    info = {"WARC-Record-ID": f"<{uuid.uuid5(uuid.NAMESPACE_URL, path).urn}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}
                    target.write(gzip.compress(_record("warcinfo", info, b"format: WARC File Format 1.1\r\n")))
                    out, count, size = path, 0, 0
                known = None if refers_to is None else json.dumps(refers_to)
                record = page_record(json.dumps(page), f"row:{task}:{seen}", url, body, digest, known, date)
                target.write(gzip.compress(record))
                count, size, seen = count + 1, size + len(record), seen + 1
                if size >= archive_bytes:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    return keep(records.mapInArrow(write, MANIFEST), "manifest")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Each archive inflated once and written anew, a gzip member a record, with its index file.

    Returns the lines of all index files.  A task takes one archive after the other.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = path.rsplit("/", 1)[-1].removesuffix(".warc.gz").replace("raw-", "records-") + f"-{attempt}"
                member, offset, lines = f"{root}/{name}.warc.gz", 0, []
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(member, compression=None) as target, store.open_output_stream(f"{root}/{name}.index", compression=None) as sidecar:
                    for record in read_records_of(inflate(source, path), path):
                        head = parse_headers(record[: record.index(b"\r\n\r\n")])
                        gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = gzip.compress(record + b"\r\n\r\n") + gzip.flush()
                        target.write(data)
                        length = head.get("x-payload-length")
                        line = {
                            "path": member, "offset": offset, "length": len(data), "record_id": head.get("warc-record-id"),
                            "record_type": head["warc-type"], "page": head.get("x-page"),
                            "payload_bytes": None if length is None else int(length),
                            "payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
                            "refers_to": head.get("x-refers-to-page"),
                        }
                        sidecar.write(json.dumps(line).encode() + b"\n")
                        lines.append(line)
                        offset += len(data)
                        if len(lines) == 5000:
                            yield pa.RecordBatch.from_pylist(lines, INDEX_ARROW)
                            lines = []
                if lines:
                    yield pa.RecordBatch.from_pylist(lines, INDEX_ARROW)

    spread = manifest.repartition(max(1, min(manifest.count(), 100_000)))
    return keep(spread.mapInArrow(rewrite, INDEX), "warc-index")


INDEX_ARROW = pa.schema([
    (name, pa.int64() if kind == "long" else pa.string()) for name, kind in (part.split() for part in INDEX.split(", "))
])


def _payload(source, path: str, offset: int, length: int) -> bytes | None:
    """The payload of one record; None for a revisit."""
    source.seek(offset)
    record = zlib.decompress(source.read(length), 31)
    end = record.index(b"\r\n\r\n")
    head = parse_headers(record[:end])
    block = record[end + 4 : end + 4 + int(head["content-length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :] if head["warc-type"] == "response" else None
    if payload is not None and hashlib.sha256(payload).hexdigest() != head["warc-payload-digest"].removeprefix("sha256:"):
        raise ValueError(f"{path} at {offset}: the payload differs from its digest")
    return payload


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of index lines, each read by itself: its line and its payload.

    A response's payload has to have the length and digest that its header tells; a
    revisit has none of its own (null).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        opened, source = None, None
        for batch in batches:
            payloads, size, start = [], 0, 0
            names = [*batch.schema.names, "payload"]
            for path, offset, length in zip(*(batch.column(name).to_pylist() for name in ("path", "offset", "length")), strict=True):
                if path != opened:
                    if source is not None:
                        source.close()
                    opened, source = path, store.open_input_file(path)
                payloads.append(_payload(source, path, offset, length))
                size += len(payloads[-1] or b"")
                if size > READ_BYTES:  # a batch of lines may stand for any number of bytes
                    lines = batch.slice(start, len(payloads))
                    yield pa.RecordBatch.from_arrays([*lines.columns, pa.array(payloads, pa.binary())], names=names)
                    start, payloads, size = start + len(payloads), [], 0
            lines = batch.slice(start, len(payloads))
            yield pa.RecordBatch.from_arrays([*lines.columns, pa.array(payloads, pa.binary())], names=names)
        if source is not None:
            source.close()

    return index.mapInArrow(read, INDEX + ", payload binary")


def archive_pages(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    folder: str | None = None,
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write pages as archives, normalise these, and read every record back.

    Returns page (JSON), record_type, payload (null for a revisit), payload_bytes,
    payload_digest, refers_to (JSON) and the place of the record.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    manifest = write_archives(plan_records(pages, id_col, url_col, body_col), folder, date, archive_bytes)
    index = normalise(manifest, folder)
    return read_records(index.where(F.col("record_type").isin("response", "revisit")), folder)
