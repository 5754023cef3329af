"""WARC archives with a Zstandard dictionary: written by tasks, listed in a manifest, read back.

An archive starts with a skippable frame that holds the dictionary; after it each record is a frame of
its own, so a reader can start at any record. The dictionary is trained on the archive's first records,
up to SAMPLE_RECORDS and SAMPLE_BYTES; all records are written with it. A task holds the sample and one
record at a time.

Each task writes one file of a name that no other attempt uses, straight into the shared store, and
returns its manifest row. The manifest is a table that Spark commits, so the files of lost or repeated
attempts are in no manifest and are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import prepare_python, quoted
from tidewater.session import scratch_path, written

# Fixed values of the format.
SKIPPABLE = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 1 << 16
SAMPLE_RECORDS = 2000
SAMPLE_BYTES = 4 << 20
LEVEL = 3
#: Stated on every record; archives of the same pages are the same bytes.
DATE = "2024-01-01T00:00:00Z"


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder or file that Spark names by URI."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record: str) -> int | None:
    value = record.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def _header_value(value: str) -> str:
    """Control characters and the percent sign as %XX, so that a header stays on one line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def _header_text(value: str) -> str:
    from urllib.parse import unquote

    return unquote(value)


def to_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit states the payload's length and digest but not the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if refers_to is None else http
    headers = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
               f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
               f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
               "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        headers.insert(3, f"WARC-Target-URI: {_header_value(url)}")
    if refers_to is not None:
        headers += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(headers).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def from_record(record: bytes) -> dict:
    """The record's fields; a response's payload is checked against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI")
    return {"page_id": _page_id(fields["WARC-Record-ID"]), "url": None if url is None else _header_text(url),
            "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": _page_id(fields["WARC-Refers-To"]) if revisit else None,
            "payload": None if revisit else payload}


class ArchiveWriter:
    """Writes records to a stream, the dictionary of the first ones ahead of them."""

    def __init__(self, out: BinaryIO):
        self.out, self.sample, self.sampled, self.compressor = out, [], 0, None
        self.records = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor is None:
            self.sample.append(record)
            self.sampled += len(record)
            if len(self.sample) < SAMPLE_RECORDS and self.sampled < SAMPLE_BYTES:
                return
            self._start()
        else:
            self.out.write(self.compressor.compress(record))

    def _start(self) -> None:
        """Train, write the dictionary's frame, then the records held back for it."""
        options = {}
        try:
            trained = zstandard.train_dictionary(
                min(DICTIONARY_BYTES, max(1024, self.sampled // 8)), self.sample, k=512, d=8, f=18, accel=4)
            content = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
            self.out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
            trained.precompute_compress(level=LEVEL)
            options["dict_data"] = trained
        except zstandard.ZstdError:
            pass  # too few or too short records to train on: the archive goes without a dictionary
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, **options)
        for record in self.sample:
            self.out.write(self.compressor.compress(record))
        self.sample = []

    def close(self) -> None:
        if self.compressor is None:
            self._start()


def read_archive(source: BinaryIO) -> Iterator[bytes]:
    """The uncompressed records of an archive, one at a time."""
    start = source.read(8)
    options = {}
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == SKIPPABLE:
        content, start = source.read(struct.unpack("<I", start[4:])[0]), b""
        if content[:4] == b"\x28\xb5\x2f\xfd":
            content = zstandard.ZstdDecompressor().decompress(content)
        options["dict_data"] = zstandard.ZstdCompressionDict(content)
    decompressor, held = zstandard.ZstdDecompressor(**options), start
    while held := held or source.read(1 << 16):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            held = held or source.read(1 << 16)
            if not held:
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(held))
            held = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def with_roles(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html",
               min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, refers_to: which record of equal payloads is the response.

    Digests that occur once are settled by a partial aggregate; only repeated ones are joined back, and
    their table is stored first, so that Spark knows its size when it chooses the join.
    """
    spark = pages.sparkSession
    rows = pages.select(quoted(page_id).cast("long").alias("page_id"), quoted(url).cast("string").alias("url"),
                        F.coalesce(quoted(payload), F.lit("")).alias("payload")).withColumn(
        "digest", F.unhex(F.sha1("payload")))
    heads = written(spark, rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1 AND head IS NOT NULL").select(
        F.col("digest").alias("repeated"), "head"), scratch_path(spark, "repeated-payloads"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("head")) & F.col("head").isNotNull(), F.col("head"))
    return rows.join(heads, rows.digest == heads.repeated, "left").select(
        "page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   *, min_bytes: int = 0) -> DataFrame:
    """Write every row as a WARC record into `.warc.zst` files below `folder`; the manifest comes back:
    path, records, bytes.

    Of rows with equal payloads of at least `min_bytes` bytes, those with the largest page_id are
    responses and the others revisit it; rows with smaller or unequal payloads are responses. A null
    payload is empty, a null url leaves its header out; a row without an id counts as smaller than any
    other. Rows that repeat id and payload are all written. A partition without rows writes no file; an
    empty table gives an empty manifest. Other columns are not archived.
    """
    spark = pages.sparkSession
    prepare_python(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = store(folder)
        writer = path = out = None
        for batch in batches:
            text = batch.column(2).cast(pa.binary())
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text.to_pylist(),
                           batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if writer is None:
                    system.create_dir(place, recursive=True)
                    path = f"{place}/{uuid.uuid4().hex}.warc.zst"
                    out = system.open_output_stream(path)
                    writer = ArchiveWriter(out)
                writer.add(to_record(*row))
        if writer is not None:
            writer.close()
            size = out.tell()
            out.close()
            yield pa.record_batch([[f"{folder}/{path.rsplit('/', 1)[1]}"], [writer.records], [size]],
                                  names=["path", "records", "bytes"])

    rows = with_roles(pages, page_id, url, payload, min_bytes)
    return written(spark, rows.mapInArrow(run, "path string, records long, bytes long"),
                   scratch_path(spark, "manifest"))


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, with `payloads`, the payload (null for revisits). Digests are checked on the way."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = store(path)
                with system.open_input_stream(place) as source:
                    rows, held = [], 0
                    for record in map(from_record, read_archive(source)):
                        rows.append({name: record[name] for name in kinds})
                        held += len(record["payload"] or b"") if payloads else 1
                        if len(rows) >= 1000 or held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    prepare_python(manifest.sparkSession)
    archives = max(1, manifest.count())
    names = {"int64": "long", "string": "string", "binary": "binary"}
    return manifest.select("path").repartition(archives, "path").mapInArrow(
        run, ", ".join(f"{field.name} {names[str(field.type)]}" for field in schema))
