"""WARC archives in Zstandard: one dictionary in front, one frame per record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; each record follows as a frame of its own. Archives are bounded in
size and written by Spark's own writer to any file system Spark knows: the text
writer copies bytes as they are, one archive a file, and its line separator is an
empty skippable frame, which every reader passes over. They are read back with
Spark's binary file source.

Pages with equal payloads are found by digest. Only digests that occur more than
once are joined back to the pages, so page bodies are moved only by that join.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaselake.llm.staging import stage

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = 0x184D2A50
FRAME = b"\x28\xb5\x2f\xfd"
#: An empty skippable frame; all its bytes are ASCII, so it can separate lines.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0)
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)
READ_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
NAMESPACE = uuid.UUID(int=0)


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit holds the HTTP headers alone; their
    Content-Length and the payload digest are still those of the full payload."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~', errors='replace')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        f"Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
        head.append(f"Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; ValueError if version, headers, lengths or digests
    are not what the format asks for."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("a WARC record without an end of headers")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC version: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit():
        raise ValueError("a Content-Length that is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes and Content-Length is {size}")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest_of(block)}":
        raise ValueError("the block's digest differs")
    kind = fields["warc-type"]
    http, found, payload = block.partition(b"\r\n\r\n")
    full = len(payload)
    for line in http.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        if name.strip().lower() == "content-length":
            full = int(value)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (full != len(payload) or digest != digest_of(payload)):
        raise ValueError("the payload's length or digest differs")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("page-id"),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": full,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number("refers-to-page-id"),
        "payload": payload if kind == "response" else None,
    }


def build_archive(records: list[bytes], dictionary_bytes: int = 16_384, sample_bytes: int = 1 << 20, level: int = 3) -> bytes:
    """Dictionary frame and record frames. The dictionary is trained on the
    archive's first records (``sample_bytes``); where they are too few or too
    alike for training, their raw beginning serves."""
    sample, held = [], 0
    for r in records:
        sample.append(r)
        held += len(r)
        if held >= sample_bytes:
            break
    try:
        words = zstandard.train_dictionary(dictionary_bytes, sample)
    except zstandard.ZstdError:
        words = zstandard.ZstdCompressionDict(b"".join(sample)[:dictionary_bytes], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = zstandard.ZstdCompressor(level=level).compress(words.as_bytes())
    writer = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=True, write_checksum=True)
    out = [struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed]
    out += [writer.compress(r) for r in records]
    return b"".join(out)


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, from its block headers."""
    checksum = data[at + 4] >> 2 & 1
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    if at + 4 * checksum > len(data):
        raise ValueError("a frame is cut off")
    return at + 4 * checksum


def read_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive, one frame at a time."""
    reader, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        if data[at : at + 4] == FRAME:
            end = frame_end(data, at)
            try:
                body = reader.decompress(data[at:end])
            except zstandard.ZstdError as e:
                raise ValueError(f"a frame cannot be decoded: {e}") from e
            yield parse_record(body)
            at = end
            continue
        if len(data) < at + 8:
            raise ValueError("a frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & ~0xF != SKIPPABLE or at + 8 + size > len(data):
            raise ValueError("neither a Zstandard nor a skippable frame")
        if magic == DICTIONARY_MAGIC and at == 0:
            words = data[8 : 8 + size]
            if words[:4] == FRAME:
                words = zstandard.ZstdDecompressor().decompress(words)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
        at += 8 + size


def with_first_copies(pages: DataFrame, id_col: str, payload: str, min_bytes: int) -> DataFrame:
    """Adds ``_first``: the smallest id among pages with the same payload, null
    where the payload is a page's own or shorter than ``min_bytes``. Digests alone
    are grouped, and those that repeat are written: while they are few Catalyst
    broadcasts them and no body is shuffled; beyond that a digest that very many
    pages share is one that adaptive execution splits."""
    keyed = pages.withColumn("_digest", F.sha1(F.col(payload)))
    long_enough = keyed.where(F.length(payload) >= min_bytes)
    repeated = long_enough.groupBy(F.col("_digest").alias("_d"), F.length(payload).alias("_n")).agg(F.min(id_col).alias("_least"), F.count(F.lit(1)).alias("_copies"))
    repeated = stage(repeated.where(F.col("_copies") > 1).drop("_copies"), "warc-repeated")
    same = (F.col("_digest") == F.col("_d")) & (F.length(payload) == F.col("_n"))
    first = F.when(~F.col(id_col).eqNullSafe(F.col("_least")), F.col("_least"))
    return keyed.join(repeated, same, "left").withColumn("_first", first).drop("_digest", "_d", "_n", "_least")


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", body: str = "html", min_bytes: int = 0, archive_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z"
) -> None:
    """Write one record per row of ``pages`` to archives under ``path``.

    The payload is ``body`` in UTF-8 (null: empty). Of rows with equal payloads of
    at least ``min_bytes``, that with the smallest id is the response and the
    others revisit it; rows that repeat its id are responses again. A null id
    gives a record without one; it is a response only if no row with the same
    payload has an id. An archive takes records until their bytes reach
    ``archive_bytes``. An empty table writes no archive.
    """
    chosen = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url).cast("string").alias("_url"), F.coalesce(F.encode(F.col(body).cast("string"), "UTF-8"), F.lit(b"")).alias("_body"))
    ready = with_first_copies(chosen, "_id", "_body", min_bytes).select("_id", "_url", "_body", "_first")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, held = [], 0
        for batch in batches:
            for page, where, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records.append(record(page, where, payload, first, first is not None, date))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield pa.record_batch({"archive": [build_archive(records)]})
                    records, held = [], 0
        if records:
            yield pa.record_batch({"archive": [build_archive(records)]})

    written = ready.mapInArrow(archives, "archive binary")
    as_text = written.select(F.col("archive").cast("string").alias("archive"))
    as_text.write.option("maxRecordsPerFile", 1).option("lineSep", SEPARATOR.decode()).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, validated: see ``READ_DDL``;
    ``payload`` is null for revisits."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                for r in read_archive(data):
                    rows.append(r)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=READ)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=READ)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, READ_DDL)


SQL = """
WITH sized AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), hashed AS (
  SELECT page_id, octet_length(body) AS payload_bytes, CAST(CAST(unhex(sha1(body)) AS BIT) AS VARCHAR) AS bits FROM sized
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY bits, payload_bytes) AS first_id FROM hashed
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INT)
    + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INT)
    + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts
"""
