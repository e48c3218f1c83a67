"""WARC archives: a writer, and a sequential reader.

Each record is one gzip member. The reader takes a file in chunks, inflates
them incrementally, frames records by their Content-Length and verifies their
digests, so it holds one chunk and the headers, whatever a record's length.
Headers may be of any length, as a URL may be.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.batches import small_batches
from marlstone.sources import materialize, shared_path

CHUNK = 1 << 16
#: A file is closed, and the next begun, once it has this many bytes.
FILE_BYTES = 256 << 20
#: Payloads below this many bytes are never written as revisits.
REVISIT_BYTES = 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long, bytes long"
RECORDS = "record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


class WarcError(ValueError):
    """An archive that is cut short, wrongly framed or altered."""


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _line(value: str) -> str:
    """A header's value on one line: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode_record(record_id: str, url: str | None, payload: bytes, refers_to: str | None = None, level: int = 6) -> bytes:
    """One gzip member with a response record or, if ``refers_to`` is given, a revisit record.

    A revisit has no payload, but the length and digest of the whole one in its headers.
    """
    block = HTTP % len(payload) + (b"" if refers_to is not None else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{_line(record_id)}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []),
        *([f"WARC-Refers-To: <urn:page:{_line(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: {_b32(hashlib.sha1(payload).digest())}",
        f"X-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: {_b32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n") + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def _inflated(stream: BinaryIO) -> Iterator[bytes | None]:
    """Chunks of each gzip member's content, and None after each member."""
    inflate, held = zlib.decompressobj(31), b""
    begun = False
    while True:
        data = held or stream.read(CHUNK)
        held = b""
        if not data:
            if begun:
                raise WarcError("the archive ends within a record")
            return
        begun = True
        try:
            out = inflate.decompress(data, CHUNK)
            while inflate.unconsumed_tail and not inflate.eof:
                yield out
                out = inflate.decompress(inflate.unconsumed_tail, CHUNK)
        except zlib.error as error:
            raise WarcError(f"not a gzip member: {error}") from error
        if out:
            yield out
        if inflate.eof:
            held, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
            yield None


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(stream: BinaryIO, keep_payload: bool = False) -> Iterator[dict]:
    """The records of an archive in order, each with its verified digests.

    Raises WarcError where the archive is cut short, wrongly framed or has a
    digest that does not fit. Payloads are dropped as they pass unless asked for.
    """
    buffer, head, warc, left, kept = bytearray(), None, {}, 0, bytearray()
    block = payload = None
    http: bytearray | None = None
    n_payload = 0
    for chunk in _inflated(stream):
        if chunk is not None:
            buffer += chunk
            if head is None:
                end = buffer.find(b"\r\n\r\n", max(0, len(buffer) - len(chunk) - 3))
                if end < 0:
                    continue
                head, warc = _headers(bytes(buffer[:end]))
                if not head.startswith("WARC/") or not warc.get("content-length", "").isdigit():
                    raise WarcError("a record without a version or a length")
                del buffer[: end + 4]
                left, block, payload, http, n_payload = int(warc["content-length"]), hashlib.sha1(), hashlib.sha1(), bytearray(), 0
                kept = bytearray()
            taken = bytes(buffer[:left])
            del buffer[: len(taken)]
            left -= len(taken)
            block.update(taken)
            if http is not None:
                http += taken
                end = http.find(b"\r\n\r\n", max(0, len(http) - len(taken) - 3))
                if end < 0:
                    continue
                taken, http = bytes(http[end + 4 :]), None
            payload.update(taken)
            n_payload += len(taken)
            if keep_payload:
                kept += taken
            continue
        if head is None or left or bytes(buffer) != b"\r\n\r\n" or http is not None:
            raise WarcError("a record's content does not have the length it states")
        if warc.get("warc-block-digest", "") != _b32(block.digest()):
            raise WarcError("a block digest does not fit")
        revisit, stated = warc.get("warc-type") == "revisit", warc.get("warc-payload-digest", "")
        if not revisit and (stated != _b32(payload.digest()) or warc.get("x-payload-length") != str(n_payload)):
            raise WarcError("a payload digest does not fit")
        bare = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
        yield {
            "record_type": warc.get("warc-type"),
            "record_id": bare(warc["warc-record-id"]),
            "target_uri": warc.get("warc-target-uri"),
            "refers_to": bare(warc["warc-refers-to"]) if revisit else None,
            "payload_bytes": int(warc["x-payload-length"]),
            "payload_digest": base64.b32decode(stated.removeprefix("sha1:")).hex(),
            "payload": bytes(kept) if keep_payload and not revisit else None,
        }
        buffer, head = bytearray(), None


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary) and refers_to of every page.

    A null html counts as empty. Among rows with equal payloads of at least
    REVISIT_BYTES, refers_to is null for the largest page_id (for each of its
    rows, if repeated) and that page_id for the others; a null page_id is
    smaller than any other. Copies of a payload are counted before the join,
    so only payloads with copies meet rows there.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= REVISIT_BYTES
    copied = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    copied = materialize(copied.select(F.col("digest").alias("of_digest"), "first_id"), "warc-copied")  # an exchange of its own, so that copies of one payload can be split
    refers = F.when(large & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    # small payloads, which many pages can share, find nothing and are spread by row
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string")))
    return rows.withColumn("key", key).join(copied, F.col("key") == F.col("of_digest"), "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Writes each partition of ``marked`` to archives below ``folder``; returns their paths.

    A task writes under a name of its own and renames the file when it is whole,
    so a lost or repeated task leaves no half archive among those listed.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, path, n, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            files.move(f"{path}.part", path)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{path}.part", compression=None)
                record = encode_record("null" if page_id is None else str(page_id), url, payload, None if refers_to is None else str(refers_to))
                out.write(record)
                n, size = n + 1, size + len(record)
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    small_batches(marked.sparkSession)
    return materialize(marked.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """The records of the archives that ``manifest`` lists, each archive read in order by one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORDS.split(", ")])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for record in read_records(stream, keep_payload):
                        rows.append(record)
                        held += len(record["payload"] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pydict({k: [r[k] for r in rows] for k in names}, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pydict({k: [r[k] for r in rows] for k in names}, schema)

    # a count given outright, as paths are so few bytes that adaptive execution would join them all in one task
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, RECORDS)


def broken_revisits(records: DataFrame) -> DataFrame:
    """(refers_to, payload_digest, payload_bytes) that revisits state and no response has under that id. Copies are counted first."""
    stated = records.where("record_type = 'revisit'").select("refers_to", "payload_digest", "payload_bytes").distinct()
    there = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return stated.join(there, stated.columns, "left_anti")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes a record per page, reads the archives back and returns what the records say.

    Raises WarcError where a revisit's length or digest is not that of the response it refers to.
    """
    folder = shared_path(spark, "warc")
    records = materialize(read_archives(write_archives(mark_revisits(pages), folder), folder).drop("payload"), "warc-records")
    if not broken_revisits(records).isEmpty():
        raise WarcError("a revisit does not have the digest of the response it refers to")
    return records.select(
        F.when(F.col("record_id") != "null", F.col("record_id")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        "target_uri",
    )
