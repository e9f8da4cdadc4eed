from __future__ import annotations

import glob
import hashlib
import struct
import tempfile

import odd
import pytest
import zstandard

from orderlens.llm import warc
from orderlens.llm.common import table


def expected(rows):
    shared, first = {}, {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            shared.setdefault(data, []).append(page)
    for data, pages in shared.items():
        first[data] = min((p for p in pages if p is not None), default=None)
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        revisit = first.get(data) is not None and page != first[data]
        out.append(
            (page, url, "revisit" if revisit else "response", first[data] if revisit else None, len(data), hashlib.sha256(data).hexdigest(), None if revisit else data)
        )
    return sorted(out, key=repr)


def plain(records):
    return sorted(
        (
            (r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload))
            for r in records.collect()
        ),
        key=repr,
    )


def test_round_trip_of_odd_pages(spark):
    assert plain(warc.archive_pages(odd.pages(spark))) == expected(odd.PAGE_ROWS)


def test_round_trip_of_the_table(spark, folder):
    pages = table(spark, folder, "pages")
    assert plain(warc.archive_pages(pages)) == expected([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_no_pages(spark):
    assert warc.archive_pages(odd.pages(spark, [])).collect() == []


def test_archives_start_with_their_dictionary_and_hold_a_frame_per_record(spark, folder):
    path = tempfile.mkdtemp(prefix="run-warc-") + "/archives"
    warc.write_archives(table(spark, folder, "pages").coalesce(1), path)
    files = glob.glob(path + "/part-*")
    assert len(files) == 1
    data = open(files[0], "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_MAGIC and size > 1000
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert dictionary.dict_id() != 0
    records = list(warc.unpack(data))
    assert len(records) == table(spark, folder, "pages").count()
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[8 + size :])
    assert first == records[0] and first.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_archives_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = [(n, f"http://x/{n}", f"{n} " * 2000) for n in range(40)]
    path = tempfile.mkdtemp(prefix="run-warc-") + "/archives"
    warc.write_archives(odd.pages(spark, rows), path)
    assert len(glob.glob(path + "/part-*")) >= 10
    assert plain(warc.read_archives(spark, path)) == expected(rows)


def test_dictionary_shrinks_records(spark, folder):
    rows = [r.asDict() | {"refers_to": None} for r in table(spark, folder, "pages").collect()]
    records = [warc.encode_record(r) for r in rows]
    alone = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    archive = warc.pack(records)
    assert len(archive) - struct.unpack_from("<II", archive)[1] < 0.9 * alone


def test_damage_is_found():
    record = warc.encode_record({"page_id": 1, "url": "http://x", "html": "abc" * 50, "refers_to": None})
    for bad in (record.replace(b"abcabc", b"abcabd", 1), record[:-5], b"", b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.decode_record(bad)
    archive = warc.pack([record])
    with pytest.raises(ValueError):
        list(warc.unpack(archive[:-30]))
