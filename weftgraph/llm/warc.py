"""WARC archives compressed with Zstandard: writer and reader.

An archive starts with a skippable frame that holds its dictionary; after it comes one frame for
each record. The reader loads the dictionary, decodes frame by frame, and validates the version
line, the mandatory headers, the block's length, the record's end and the payload's digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import open_system
from .shared import fresh_path, is_small, write_out

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")

LEAST_REVISIT = 1000  # bytes of payload
ARCHIVE_BYTES = 64 << 20  # an archive is closed once it is larger
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20  # of the first records, for the dictionary
DATE = "2024-01-01T00:00:00Z"
_CHUNK = 1 << 18


class WarcError(ValueError):
    pass


def record_bytes(row_id: Any, url: str | None, payload: bytes, digest: str, refers_to: Any = None, payload_bytes: int | None = None) -> bytes:
    """One WARC record. With ``refers_to`` it is a revisit: its block is the HTTP header alone."""
    size = len(payload) if payload_bytes is None else payload_bytes
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:row:{'' if row_id is None else row_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:row:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """From the first records of an archive; their plain bytes where they are too few to train on."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples, d=8, k=256)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes one archive: under a name of its own until it is closed."""

    def __init__(self, address: str):
        self.address = address
        self.system, self.path = open_system(address)
        self.part, self.waiting, self.size, self.records, self.out = f"{self.path}.{uuid.uuid4().hex}.part", [], 0, 0, None
        self.waiting_bytes = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.out is not None:
            return self._frame(record)
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if self.waiting_bytes >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        trained = train_dictionary([x[: 16 << 10] for x in self.waiting])
        self.codec = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.system.open_output_stream(self.part, compression=None)
        body = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
        self.out.write(SKIPPABLE.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body)
        self.size = 8 + len(body)
        for record in self.waiting:
            self._frame(record)
        self.waiting, self.waiting_bytes = [], 0

    def _frame(self, record: bytes) -> None:
        frame = self.codec.compress(record)
        self.out.write(frame)
        self.size += len(frame)

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self._begin()
        self.out.close()
        self.system.move(self.part, self.path)
        return self.address, self.records, self.size


def _exactly(source: BinaryIO, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise WarcError("the archive ends within its dictionary")
    return data


def load_dictionary(source: BinaryIO) -> zstandard.ZstdCompressionDict:
    """From the leading skippable frame, which may itself be compressed."""
    if int.from_bytes(_exactly(source, 4), "little") != SKIPPABLE:
        raise WarcError("no dictionary frame at the start")
    body = _exactly(source, int.from_bytes(_exactly(source, 4), "little"))
    if body[:4] == ZSTD_MAGIC:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return zstandard.ZstdCompressionDict(body)


def frames(source: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(number, content) of each frame after the dictionary; holds one record and one chunk at most."""
    codec = zstandard.ZstdDecompressor(dict_data=load_dictionary(source))
    rest, number = b"", 0
    while rest or (rest := source.read(_CHUNK)):
        one, parts = codec.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            if not (rest := source.read(_CHUNK)):
                raise WarcError(f"frame {number} is cut off")
        yield number, b"".join(parts)
        number += 1


def parse_record(data: bytes) -> dict[str, Any]:
    """Headers and payload of a frame that must hold exactly one valid record."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    if not blank:
        raise WarcError("no end of headers")
    version, *lines = head.decode().split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"version {version[:20]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"header {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    if lacking := [x for x in MANDATORY if x.lower() not in headers]:
        raise WarcError("no " + ", ".join(lacking))
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError("the block's length isn't Content-Length")
    http, blank, payload = rest[:-4].partition(b"\r\n\r\n")
    if not blank:
        raise WarcError("no HTTP header")
    lengths = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    kind, size = headers["warc-type"], lengths[0] if lengths else len(payload)
    kind_of, _, coded = headers.get("warc-payload-digest", "").partition(":")
    digest = base64.b32decode(coded).hex() if kind_of == "sha1" else None
    if kind == "response":
        if size != len(payload):
            raise WarcError("the payload's length isn't that of the HTTP header")
        own = hashlib.sha1(payload).hexdigest()
        if digest not in (None, own):
            raise WarcError("the payload doesn't have its digest")
        digest = own
    elif kind != "revisit" or payload or "warc-refers-to" not in headers:
        raise WarcError(f"record of type {kind!r}")
    return {"headers": headers, "record_type": kind, "payload": payload, "payload_bytes": size, "payload_digest": digest}


def row_of(record_id: str | None) -> int | None:
    own = (record_id or "").removeprefix("<urn:row:").removesuffix(">")
    return int(own) if own else None


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """row_id, url, html, digest, refers_to: null for a response, else the row_id of the response.

    Only digests are grouped, with partial counts first, so that one payload with a third of all
    rows costs a row a task. The groups of several rows are written out. Few of them are
    broadcast, and no payload is shuffled. Else the rows that have a digest are joined with them,
    both sides dealt for that join alone, so AQE may split a hot payload; the small payloads, which
    have none, aren't shuffled. Payloads are equal if their SHA-256 and length are.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("row_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("same", F.when(F.octet_length("html") >= LEAST_REVISIT, F.unhex(F.sha2("html", 256))))
    groups = rows.filter("same is not null").groupBy("same").agg(F.max("row_id").alias("first_id"), F.count("*").alias("n"))
    groups = write_out(groups.filter("n > 1 and first_id is not null").select("same", "first_id"), "warc-groups")
    if is_small(groups):
        found = rows.join(F.broadcast(groups), "same", "left")
    else:
        alone = rows.filter("same is null").withColumn("first_id", F.lit(None).cast("long"))
        found = rows.filter("same is not null").join(groups, "same", "left").unionByName(alone)
    later = F.when(F.col("row_id").isNull() | (F.col("row_id") < F.col("first_id")), F.col("first_id"))
    return found.select("row_id", "url", "html", F.sha1("html").alias("digest"), later.alias("refers_to"))


def write_archives(planned: DataFrame, address: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives below ``address``; returns their list (path, records, bytes), kept in the shared folder.

    Each try of a task writes archives of its own names, and only those of the try that Spark
    accepts are listed, so lost executors leave nothing that is read.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, done, writer = TaskContext.get(), [], None
        stem = f"{address}/{context.partitionId():06d}-{uuid.uuid4().hex}"
        for b in batches:
            for row_id, url, html, digest, refers_to in zip(*(b.column(i) for i in range(5)), strict=True):
                html = (html.as_py() or "").encode()
                if writer is None:
                    writer = ArchiveWriter(f"{stem}-{len(done):05d}.warc.zst")
                writer.add(record_bytes(row_id.as_py(), url.as_py(), html, digest.as_py(), refers_to.as_py(), len(html)))
                if writer.size + writer.waiting_bytes >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "records", "bytes"])

    return write_out(planned.select("row_id", "url", "html", "digest", "refers_to").mapInArrow(written, "path string, records long, bytes long"), "warc-list")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """row_id, url, record_type, payload_bytes, payload_digest, refers_to, path, frame (and payload) of each record.

    archives: a column ``path``. A record or archive that isn't valid raises ``WarcError`` with
    its place; nothing is skipped.
    """
    schema = "row_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, path string, frame long" + ", payload binary" * with_payload
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: 8 + with_payload]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for address in b.column("path").to_pylist():
                system, path = open_system(address)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as source:
                    for number, data in frames(source):
                        try:
                            r = parse_record(data)
                            head = r["headers"]
                            row = (row_of(head["warc-record-id"]), head.get("warc-target-uri"), r["record_type"], r["payload_bytes"], r["payload_digest"], row_of(head.get("warc-refers-to")), address, number)
                        except ValueError as e:
                            raise WarcError(f"{address}, frame {number}: {e}") from e
                        rows.append(row + ((r["payload"],) if with_payload else ()))
                        held += len(r["payload"]) if with_payload else 200
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    # one archive a task, as far as there are cores for them
    spread = archives.select("path").repartition(min(max(1, archives.count()), 10_000))
    return spread.mapInArrow(read, schema)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", address: str | None = None, with_payload: bool = True) -> DataFrame:
    """Write a record for each row of ``pages``, then read the archives back (see ``read_archives``).

    Of records with equal payloads of at least 1000 bytes, that with the largest id is the
    response and the others revisit it. Rows that repeat that id are responses too, and each row
    has a record of its own. A null html is an empty payload. A null id has an empty record id and
    never becomes the response of a group that has another. A payload of any length is one record,
    held in memory by the task that writes or reads it. An empty table writes no archive and gives
    no rows. Other columns are ignored.
    """
    planned = plan_records(pages, id_col, url_col, html_col)
    return read_archives(write_archives(planned, address or fresh_path(pages.sparkSession, "warc")), with_payload)
