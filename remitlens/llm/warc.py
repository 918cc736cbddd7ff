"""WARC archives compressed record by record with an embedded Zstandard dictionary.

Each task writes archives of bounded size straight to the shared folder. An
archive starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary
trained on its own first records; every record is one Zstandard frame that uses
it, so any record can be read alone. Archives are written under a name of their
own and renamed when complete, so a repeated task replaces its own file.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitlens.llm import hashing
from remitlens.llm.store import prepare, shared_dir

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_SIZE = 64 << 10
#: Records of an archive that its dictionary is trained on: bytes, and bytes of each record.
SAMPLE_BYTES, SAMPLE_RECORD = 2 << 20, 16 << 10
ARCHIVE_BYTES = 64 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str = "") -> str:
    """Stable id of a page's record; a page without an id is named by its digest."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{digest if page_id is None else page_id}')}>"


def _value(text: str | None) -> str:
    """A header value on one line."""
    return " ".join((text or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has headers and no block."""
    block = payload if refers_to is None else b""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _value(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    headers += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


class ArchiveWriter:
    """Collects the dictionary's sample, then compresses record by record into one file."""

    def __init__(self, filesystem: fs.FileSystem, path: str, level: int):
        self._fs, self._path, self._part, self._level = filesystem, path, f"{path}.{uuid.uuid4().hex}.open", level
        self._out = filesystem.open_output_stream(self._part, compression=None)
        self._waiting: list[bytes] = []
        self._compressor: zstandard.ZstdCompressor | None = None
        self.bytes = self.sampled = self.records = 0

    def add(self, raw: bytes) -> None:
        self.records += 1
        self.bytes += len(raw)
        if self._compressor is not None:
            self._out.write(self._compressor.compress(raw))
            return
        self._waiting.append(raw)
        self.sampled += len(raw)
        if self.sampled >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        samples = [raw[:SAMPLE_RECORD] for raw in self._waiting]
        try:
            trained = zstandard.train_dictionary(DICTIONARY_SIZE, samples, k=256, d=8, level=self._level)
            data = trained.as_bytes()
        except zstandard.ZstdError:  # too few or too short records: they serve as they are
            data = b"".join(samples)[-DICTIONARY_SIZE:]
        self._out.write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        self._compressor = zstandard.ZstdCompressor(level=self._level, dict_data=_dictionary(data))
        for raw in self._waiting:
            self._out.write(self._compressor.compress(raw))
        self._waiting = []

    def close(self) -> None:
        if self._compressor is None:
            self._start()
        self._out.close()
        self._fs.move(self._part, self._path)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def read_archive(stream):
    """Records of an archive, one at a time; holds the largest record at most."""
    head = stream.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(stream.read(size)))
    rest = b""
    while True:
        if not rest:
            rest = stream.read(1 << 18)
        if not rest:
            return
        frame, out = decompressor.decompressobj(), io.BytesIO()
        while not frame.eof:
            if not rest:
                rest = stream.read(1 << 18)
                if not rest:
                    raise ValueError("archive ends inside a record")
            out.write(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield out.getvalue()


_WRITTEN = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _write(folder: str, level: int, date: str):
    def run(batches):
        from pyspark import TaskContext

        filesystem, root = fs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        part, n, writer, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                if writer is None:
                    name = f"part-{part:05d}-{n:04d}.warc.zst"
                    writer, n = ArchiveWriter(filesystem, f"{root}/{name}", level), n + 1
                writer.add(record(row["page_id"], row["url"], payload, row["refers_to"], row["digest"], date))
                if writer.bytes >= ARCHIVE_BYTES:
                    writer.close()
                    done.append((name, writer.records, writer.bytes))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((name, writer.records, writer.bytes))
        yield pa.RecordBatch.from_pylist([dict(zip(_WRITTEN.names, x)) for x in done], schema=_WRITTEN)

    return run


_READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary())]
)


def _read(folder: str, blocks: bool):
    def run(batches):
        filesystem, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows, size = [], 0
                with filesystem.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in read_archive(stream):
                        headers, block = parse(raw)
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and payload_digest(block) != digest:
                            raise ValueError(f"{name}: page {headers['X-Page-ID']} does not match its digest")
                        refers = headers.get("X-Refers-To-Page-ID")
                        rows.append(
                            {"page_id": int(headers["X-Page-ID"]) if headers["X-Page-ID"] else None, "url": headers["WARC-Target-URI"],
                             "payload_bytes": len(block) if kind == "response" else int(headers["X-Payload-Length"]),
                             "payload_digest": digest, "record_type": kind, "refers_to": int(refers) if refers else None,
                             "block": block if blocks else None}
                        )
                        size += len(block) if blocks else 100
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return run


_DIGESTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("digest", pa.string())])


def _digest(batches):
    for batch in batches:
        html = batch.column("html").fill_null("")
        digests = [payload_digest(x.encode()) for x in html.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), html, pa.array(digests, pa.string())], schema=_DIGESTED)


def write_archives(pages: DataFrame, folder: str, level: int = 3, smallest: int = 0, date: str | None = None) -> DataFrame:
    """Write the archives and return (archive, records, bytes), one row per file in ``folder``.

    ``pages(page_id, url, html)``; the payload is the html in UTF-8. Of records
    with equal payloads of at least ``smallest`` bytes the one with the largest
    page_id is a response and the others are revisits of it. The frame is lazy:
    write it (or read it once) to make the archives.

    Defined cases: a null html is an empty payload; null urls are empty; payloads
    of any length are whole; rows that repeat a page_id and payload are separate
    records, responses all if the page_id is the largest; a page with a null
    page_id is a response; other columns are ignored; an empty table writes no
    archive.
    """
    prepare(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    digested = named.mapInArrow(_digest, "page_id long, url string, html string, digest string")
    responses = digested.groupBy("digest").agg(F.max("page_id").alias("response"))
    small = F.octet_length("html") < smallest
    placed = digested.join(responses, "digest").select(
        "page_id", "url", "html", "digest", F.when(~small & (F.col("page_id") != F.col("response")), F.col("response")).alias("refers_to")
    )
    return placed.sortWithinPartitions("page_id").mapInArrow(_write(folder, level, date), "archive string, records long, bytes long")


def read_archives(archives: DataFrame, folder: str, blocks: bool = True) -> DataFrame:
    """Records of the archives named in ``archives(archive)``; responses are checked against their digests.

    (page_id, url, payload_bytes, payload_digest, record_type, refers_to, block);
    ``payload_bytes`` and digest of a revisit are those of the full payload. With
    ``blocks=False`` the block is null. A damaged archive raises an error.
    """
    prepare(archives.sparkSession)
    n = archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("archive").repartition(4 * n, "archive").mapInArrow(
        _read(folder, blocks),
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary",
    )


def archive_folder(spark) -> str:
    """A new folder for archives in the shared folder, as a URI."""
    root = shared_dir(spark)
    return f"{root if '://' in root or root.startswith('file:') else 'file://' + root}/llm/warc-{uuid.uuid4().hex}"
