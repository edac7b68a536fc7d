"""Operator 10: round trips and damaged archives."""

import base64
import hashlib
import struct

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import warc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 2**62)), st.one_of(st.none(), st.text(st.characters(codec="utf-8"))), st.binary(max_size=300)), max_size=30))
def test_archives_round_trip(rows):
    records = [warc.build_record(i, u, p, None) for i, u, p in rows]
    back = [warc.parse_record(r) for r in warc.archive_records(warc.build_archive(records))]
    assert [(b["page_id"], b["url"], b["payload"]) for b in back] == [(i, None if u is None else u.strip(" \t"), p) for i, u, p in rows]


def test_dictionary_leads_and_may_be_plain():
    records = [warc.build_record(i, "http://a/", (f"<html>{i} same words in every page " * 20).encode(), None) for i in range(80)]
    archive = warc.build_archive(records)
    magic, size = struct.unpack_from("<II", archive)
    assert magic == warc.DICTIONARY_MAGIC and list(warc.archive_records(archive)) == records
    raw = zstandard.ZstdDecompressor().decompress(archive[8 : 8 + size])
    plain = struct.pack("<II", magic, len(raw)) + raw + archive[8 + size :]
    assert list(warc.archive_records(plain)) == records


def damaged():
    record = warc.build_record(1, "http://a/", b"payload", None)
    yield "cut frame", warc.build_archive([record])[:-3]
    yield "not a frame", b"WARC/1.1 plain"
    yield "bad dictionary", struct.pack("<II", warc.DICTIONARY_MAGIC, 8) + b"nonsense" + warc.build_archive([record])
    yield "short dictionary", struct.pack("<II", warc.DICTIONARY_MAGIC, 99) + b"x"
    # A frame of one byte that claims 2**40 bytes, and one that claims 2**30 and is cut short.
    for claim in (1 << 40, 1 << 30):
        yield f"claims {claim}", struct.pack("<IBQ", warc.FRAME_MAGIC, 0b11100000, claim) + bytes([1 | 1 << 3, 0, 0]) + b"x"
    yield "length", warc.build_archive([record.replace(b"payload", b"payloads")])
    yield "digest", warc.build_archive([record.replace(b"payload", b"pAyload")])
    yield "no version", warc.build_archive([record[4:]])
    yield "no type", warc.build_archive([record.replace(b"WARC-Type: response\r\n", b"")])
    yield "type", warc.build_archive([record.replace(b"Type: response", b"Type: respond!")])


@pytest.mark.parametrize("name, content", list(damaged()))
def test_damage_is_found(spark, name, content):
    archives = spark.createDataFrame([("a", bytearray(content))], "path string, content binary")
    (row,) = warc.read_archives(archives, strict=False).collect()
    assert row["error"].startswith("a: ") and row["page_id"] is None
    with pytest.raises(Exception, match="a: "):
        warc.read_archives(archives).collect()


def test_pages_come_back_with_revisits(spark, tmp_path):
    rows = [(1, "u", "same"), (5, "u", "same"), (3, None, "same"), (2, "a\nb%", ""), (4, "u", None), (7, "u", "ünï"), (None, "u", "same"), (8, "u", "x" * 300_000), (5, "u", "same")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, record_type string")
    archives = warc.write_archives(pages, archive_bytes=1000)
    for r in archives.collect():
        (tmp_path / r["path"]).write_bytes(r["content"])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(str(tmp_path))
    got = warc.read_archives(files).collect()
    assert len(got) == len(rows)
    owner = {"same": 5, "": 4}
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r["page_id"])
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        refers = owner.get(html) if owner.get(html) != r["page_id"] else None
        assert (r["payload_bytes"], r["payload_digest"], r["refers_to"]) == (len(html.encode()), digest, refers)
        assert r["record_type"] == ("revisit" if refers else "response")
        assert refers is not None or bytes(r["payload"]) == html.encode()
    assert {r["url"] for r in got if r["page_id"] == 2} == {"a\nb%"}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    least = warc.read_archives(warc.write_archives(pages, least_bytes=5)).collect()
    assert {r["record_type"] for r in least} == {"response"}
