"""Dictionary-compressed WARC archives: one record per page, written and read back.

An archive is a sequence of Zstandard frames, after the public convention for
``.warc.zst`` files: a skippable frame that holds the dictionary comes first,
then every record is a frame of its own, compressed with that dictionary. The
dictionary is trained on records of the archive itself. Each archive ends with
an empty skippable frame, which readers pass over.

A task packs its pages into archives of bounded size, one per row, and Spark's
own writer puts every row into a file of its own. The files thus go through
Spark's commit protocol: a task that is lost or run twice leaves no partial or
double archive, and any store that Spark can write to will do.

Pages with equal payloads of at least ``MIN_SHARED`` bytes are stored once, as
the response with the smallest page_id; all others become revisit records that
refer to it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import map_rows
from orderlens.session import fresh_path

MIN_SHARED = 100
# Uncompressed bytes of records in an archive; a larger record gets an archive to itself.
ARCHIVE_BYTES = 16 * 1024 * 1024
DICTIONARY_BYTES = 64 * 1024
# Training reads records evenly spread over the archive, up to so many bytes.
TRAINING_BYTES = 2 * 1024 * 1024
LEVEL = 3

# Fixed values of the formats: frame marks, line ends, header names.
DICTIONARY_MAGIC = 0x184D2A5D
SKIP_FIRST, SKIP_LAST = 0x184D2A50, 0x184D2A5F
END_FRAME = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, payload binary"
)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    name = record_id.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def _header_text(value: str) -> str:
    """A header value on one line: control characters, DEL and % are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "%\x7f" else c for c in value)


def _header_value(value: str) -> str:
    out, at = [], 0
    while (found := value.find("%", at)) >= 0:
        out += [value[at:found], chr(int(value[found + 1 : found + 3], 16))]
        at = found + 3
    return "".join([*out, value[at:]])


def encode_record(row: dict) -> bytes:
    """The bytes of one record: WARC header, HTTP header and, in responses, the payload."""
    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    shared = row["refers_to"] is not None
    block = http if shared else http + payload
    fields = [
        ("WARC-Type", "revisit" if shared else "response"),
        ("WARC-Record-ID", _record_id(row["page_id"])),
        ("WARC-Date", WARC_DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("Content-Length", str(len(block))),
    ]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", _header_text(row["url"])))
    if shared:
        fields += [("WARC-Refers-To", _record_id(row["refers_to"])), ("WARC-Profile", REVISIT_PROFILE)]
    lines = [VERSION, *(f"{name}: {value}".encode("utf-8", "surrogatepass") for name, value in fields)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    return {name.decode().lower(): value.decode("utf-8", "surrogatepass") for name, value in pairs}


def decode_record(data: bytes) -> dict:
    """One record's fields; raises ValueError if it is damaged."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(VERSION):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's block has another length than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_fields(http)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    url = fields.get("warc-target-uri")
    return {
        "page_id": _page_id(fields["warc-record-id"]),
        "url": None if url is None else _header_value(url),
        "record_type": fields["warc-type"],
        "refers_to": _page_id(fields["warc-refers-to"]) if revisit else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records spread evenly over the list; none if they are too few to train on."""
    step = max(1, sum(map(len, records)) // TRAINING_BYTES)
    samples = [r[:TRAINING_BYTES] for r in records[::step]]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    if len(samples) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=1024, d=8)
    except zstandard.ZstdError:  # the samples have nothing in common
        return None


def pack(records: list[bytes]) -> bytes:
    """An archive of the records; without a dictionary frame if none could be trained."""
    dictionary = train(records)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    out = [compressor.compress(r) for r in records]
    if dictionary is not None:
        data = dictionary.as_bytes()
        out.insert(0, struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
    return b"".join(out)


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    view, at, dictionary = memoryview(archive), 0, None
    if len(view) >= 8:
        magic, size = struct.unpack_from("<II", view)
        if magic == DICTIONARY_MAGIC:
            dictionary, at = zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size])), 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if SKIP_FIRST <= magic <= SKIP_LAST:
            at += 8 + size
            continue
        frame, parts = decompressor.decompressobj(), []
        step = 64 * 1024
        while not frame.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            parts.append(frame.decompress(view[at : at + step]))
            at += min(step, len(view) - at)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def assign_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to): the page each row revisits, null for responses."""
    rows = pages.select("page_id", "url", "html")
    digest, size = F.sha2(F.coalesce("html", F.lit("")), 256), F.octet_length(F.coalesce("html", F.lit("")))
    keyed = rows.withColumn("digest", F.when(size >= MIN_SHARED, digest))
    first = (
        pages.select("page_id", digest.alias("digest"), size.alias("size"))
        .filter(F.col("size") >= MIN_SHARED)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "first_id")
    )
    other = F.col("first_id").isNotNull() & (~F.col("page_id").eqNullSafe(F.col("first_id")))
    joined = keyed.join(first, "digest", "left")
    return joined.select("page_id", "url", "html", F.when(other, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) into archives below ``path``.

    A null html is an empty payload. Equal payloads of at least 100 bytes:
    rows with the smallest page_id are responses (all of them, if that page_id
    is repeated), other rows, a null page_id included, are revisits; if every
    page_id is null, all are responses. Other columns are ignored. An empty
    table writes no archive.
    """

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        records, size = [], 0
        for row in rows:
            record = encode_record(row)
            if records and size + len(record) > ARCHIVE_BYTES:
                yield {"archive": pack(records)}
                records, size = [], 0
            records.append(record)
            size += len(record)
        if records:
            yield {"archive": pack(records)}

    archives = map_rows(assign_records(pages), work, "archive binary")
    text = archives.select(F.col("archive").cast("string").alias("value"))
    text.write.option("maxRecordsPerFile", 1).option("lineSep", END_FRAME).text(path)


def read_archives(spark, path: str) -> DataFrame:
    """All records below ``path``, payloads included, each checked against its length and digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            yield from map(decode_record, unpack(row["content"]))

    return map_rows(files, work, RECORD_SCHEMA)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages below a fresh path of the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
