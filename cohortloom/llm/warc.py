"""Archives of web records, each record a zstandard frame, with the dictionary in a leading skippable frame.

An archive is one binary value: a skippable frame that holds the dictionary (itself compressed), then one
frame for each record. Archives are rows of a table, so any store that Spark reads can hold them; the
reader takes nothing but their bytes.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the public formats: the skippable frame of a dictionary and the version line.
DICTIONARY_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
BREAK = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_BYTES = 100
ARCHIVE_BYTES = 8 << 20
"""Payload bytes after which an archive is closed; a longer record has one of its own."""
DICTIONARY_BYTES = 32 << 10
STEP = 32 << 10
DATE = "2000-01-01T00:00:00Z"


class FormatError(ValueError):
    """An archive or a record that breaks the format."""


def dictionary_of(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on the samples, or their heads as they are if there are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(s[:1024] for s in samples)[:size]


def dictionary_frame(content: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9, write_checksum=True).compress(content)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record; a revisit has headers only."""
    body = payload if kind == "response" else b""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c for c in url or "" if c.isprintable())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        *([("X-Page-Id", str(page_id))] if page_id is not None else []),
        *([("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", str(refers_to))] if kind == "revisit" else []),
        ("Content-Type", "text/html;charset=utf-8"),
        ("Content-Length", str(len(body))),
    ]
    head = BREAK.join([VERSION, *(f"{k}: {v}".encode() for k, v in fields)])
    return head + BREAK + BREAK + body + BREAK + BREAK


def parse_record(raw: bytes) -> dict:
    """Headers in lower case and ``body``; checks version, header lines, lengths and, of a response, the digest."""
    head, gap, rest = raw.partition(BREAK + BREAK)
    lines = head.split(BREAK)
    if not gap or lines[0] != VERSION:
        raise FormatError("not a record of this version")
    fields: dict = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip() or name.strip().lower() in fields:
            raise FormatError(f"bad header line: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "x-payload-length") if k not in fields]
    if missing:
        raise FormatError(f"missing headers: {missing}")
    if not fields["content-length"].isdigit() or not fields["x-payload-length"].isdigit():
        raise FormatError("bad length")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != BREAK + BREAK:
        raise FormatError("the record is not as long as it says")
    body = rest[:length]
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        if hashlib.sha256(body).hexdigest() != digest or len(body) != int(fields["x-payload-length"]):
            raise FormatError("the payload differs from its digest or length")
    elif kind != "revisit" or "x-refers-to-page" not in fields or length:
        raise FormatError(f"bad record of type {kind}")
    return fields | {"body": body, "digest": digest}


def read_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive, one frame at a time; an archive without a dictionary is read as well."""
    at, held = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise FormatError("the dictionary frame is cut off")
        content = data[8 : 8 + size]
        if content[:4] == zstandard.FRAME_HEADER:
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        held, at = zstandard.ZstdCompressionDict(content), 8 + size
    unpack = zstandard.ZstdDecompressor(dict_data=held) if held else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < len(data):
        if bytes(view[at : at + 4]) != zstandard.FRAME_HEADER:
            raise FormatError(f"no frame at byte {at}")
        frame, parts = unpack.decompressobj(), []
        start = at
        try:
            while not frame.eof and at < len(data):
                parts.append(frame.decompress(view[at : at + STEP]))
                at += STEP
        except zstandard.ZstdError as e:
            raise FormatError(f"bad frame at byte {start}: {e}") from e
        if not frame.eof:
            raise FormatError(f"the frame at byte {start} is cut off")
        at = min(at, len(data)) - len(frame.unused_data)
        raw = b"".join(parts)
        yield parse_record(raw)


def archives(pages: DataFrame, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive binary): the pages' records, some megabytes each; rows page_id, url, html.

    Of pages with equal payloads of at least ``least`` bytes, the one with the smallest id is a response and
    the others revisit it; if its id repeats, each row with that id is a response. Rows without an id are
    responses. A null html is an empty payload. Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).filter("times > 1").select("digest", "first")
    rows = rows.join(first, "digest", "left").select("page_id", "url", "digest", "payload", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            whole = [r[2] for r in held if r[4] is None]
            content = dictionary_of([p[:4096] for p in whole[:500] if p])
            pack = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(content) if content else None)
            frames = [dictionary_frame(content)] if content else []
            frames += [pack.compress(record_bytes(page, url, payload, digest, "response" if first is None else "revisit", first)) for page, url, payload, digest, first in held]
            return pa.RecordBatch.from_pydict({"archive": pa.array([b"".join(frames)], pa.binary())})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if held and size + len(row[2]) > archive_bytes:
                    yield close()
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield close()

    return rows.mapInArrow(write, "archive binary")


def records(stored: DataFrame) -> DataFrame:
    """Records of a table of archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, body."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("body", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for f in read_archive(archive.as_py()):
                    page, first = f.get("x-page-id"), f.get("x-refers-to-page")
                    rows.append((None if page is None else int(page), f.get("warc-target-uri"), int(f["x-payload-length"]), f["digest"], f["warc-type"], None if first is None else int(first), f["body"]))
                    if len(rows) == 500:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return stored.select("archive").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary")
