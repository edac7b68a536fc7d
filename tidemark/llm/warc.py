"""Operator 10: WARC archives of one Zstandard frame per record, with a leading dictionary."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import reliable_checkpoint

#: Fixed values of the two formats: the dictionary's skippable frame, and the magics of
#: a frame and of a dictionary.
DICTIONARY_MAGIC, FRAME_MAGIC, RAW_DICTIONARY_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """Line ends and percent signs of a value escaped, so that it stays on its line."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain_value(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record when ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of a record; ValueError where headers, lengths or the digest don't hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip(" \t")
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in fields:
            raise ValueError(f"no {needed}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    block = rest[:-4]
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = next((v.strip() for n, _, v in (h.partition(b":") for h in http.split(b"\r\n")[1:]) if n.lower() == b"content-length"), b"")
    if not gap or not length.isdigit():
        raise ValueError("no HTTP header with a length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        if len(payload) != int(length):
            raise ValueError("the payload's length differs from the HTTP header")
        if digest != payload_digest(payload):
            raise ValueError("the payload digest differs")
    elif kind == "revisit":
        if "warc-refers-to" not in fields or payload:
            raise ValueError("a revisit without the record it refers to, or with a payload")
    else:
        raise ValueError(f"unknown record type {kind[:40]!r}")
    number = lambda text: int(text.removeprefix("<urn:page:").removesuffix(">") or 0) if text not in (None, "<urn:page:>") else None
    uri = fields.get("warc-target-uri")
    return {
        "page_id": number(fields["warc-record-id"]),
        "url": None if uri is None else _plain_value(uri),
        "record_type": kind,
        "refers_to": number(fields.get("warc-refers-to")),
        "payload_bytes": int(length),
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def train_dictionary(records: list[bytes], size: int = 16_384, most: int = 64, cut: int = 8_192) -> bytes:
    """A dictionary from the first records of an archive; empty when they are too few."""
    samples = [r[:cut] for r in records[:most]]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def build_archive(records: list[bytes], level: int = 3) -> bytes:
    """A dictionary in a skippable frame, if there is one, then a frame for each record."""
    dictionary = train_dictionary(records)
    head, shared = b"", None
    if dictionary:
        packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
        head = struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=level)
    press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True)
    return head + b"".join(map(press.compress, records))


def frame_length(data: memoryview) -> int:
    """Bytes of the frame at the start, from its headers."""
    if len(data) < 6 or struct.unpack_from("<I", data)[0] != FRAME_MAGIC:
        raise ValueError("no Zstandard frame")
    flags = data[4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at = 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


#: Claimed sizes up to which a frame is decoded in one step.
_BELIEVED = 1 << 26


def _streamed(reader: zstandard.ZstdDecompressor, frame: memoryview, max_record: int) -> bytes:
    parts, total = [], 0
    with reader.stream_reader(frame) as stream:
        while part := stream.read(1 << 20):
            parts.append(part)
            total += len(part)
            if total > max_record:
                raise ValueError(f"a frame holds more than {max_record} bytes")
    return b"".join(parts)


def archive_records(content: bytes, max_record: int = 1 << 31) -> Iterator[bytes]:
    """Decoded frames of an archive, one record each."""
    data, at, shared = memoryview(content), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = bytes(data[8 : 8 + size])
        if len(raw) != size or size < 4:
            raise ValueError("the dictionary is cut off")
        if struct.unpack_from("<I", raw)[0] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        if struct.unpack_from("<I", raw)[0] != RAW_DICTIONARY_MAGIC:
            raise ValueError("the leading frame holds no dictionary")
        shared, at = zstandard.ZstdCompressionDict(raw), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=shared)
    while at < len(data):
        size = frame_length(data[at:])
        frame = data[at : at + size]
        try:
            claimed = zstandard.frame_content_size(frame)
            if claimed > max_record:
                raise ValueError(f"a frame claims {claimed} bytes")
            # A size that is claimed is only believed where it is small; else memory follows what is decoded.
            yield reader.decompress(frame) if 0 <= claimed <= _BELIEVED else _streamed(reader, frame, max_record)
        except zstandard.ZstdError as error:
            raise ValueError(f"a frame can't be decoded: {error}") from error
        at += size


def _write(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def packed() -> pa.RecordBatch:
            content = build_archive(held)
            name = hashlib.sha256(content).hexdigest()[:32] + ".warc.zst"
            return pa.record_batch([pa.array([name]), pa.array([content], pa.binary())], ["path", "content"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                record = build_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers_to.as_py())
                held.append(record)
                total += len(record)
                if total >= archive_bytes:
                    yield packed()
                    held, total = [], 0
        if held:
            yield packed()

    return run


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, archive_bytes: int = 4 << 20
) -> DataFrame:
    """Archives (path, content) of a record per page, payload the html in UTF-8.

    Of pages with equal payloads of ``least_bytes`` or more, the one with the largest id is
    a response and the others revisit it; smaller payloads are all responses. Equal payloads
    share their SHA-256; the largest id is pre-aggregated, and a payload of a third of the
    pages is joined by splitting. An archive holds about ``archive_bytes`` of records, one
    at least, and has its own dictionary. The frame can be saved by any writer, or row by
    row as ``.warc.zst`` files.

    Null html is an empty payload; a null url gives no target; pages of a null id are
    responses unless another page has the payload; rows that repeat the largest id are all
    responses. An empty table gives no archive. Other columns are not read.
    """
    known = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    named = known.withColumn("_sha", F.sha2(F.coalesce("html", F.lit("")), 256))
    owner = named.groupBy("_sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).where("copies > 1 AND owner IS NOT NULL")
    # The checkpoint takes the sum's partitioning away, so that a payload of many pages can be split.
    owner = reliable_checkpoint(owner.drop("copies"))
    small = F.coalesce(F.octet_length("html"), F.lit(0)) < least_bytes
    refers = F.when(~small & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    joined = named.join(owner, "_sha", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    return joined.mapInArrow(_write(archive_bytes), "path string, content binary")


def _read(payloads: bool, strict: bool):
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "error"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                rows = []
                try:
                    for record in archive_records(content.as_py()):
                        row = parse_record(record) | {"error": None}
                        rows.append(row if payloads else row | {"payload": None})
                except ValueError as error:
                    if strict:
                        raise ValueError(f"{path.as_py()}: {error}") from error
                    rows.append({"error": f"{path.as_py()}: {error}"})
                yield pa.record_batch([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return run


def read_archives(archives: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """Records of ``archives(path, content)``, such as ``spark.read.format("binaryFile")`` gives.

    The dictionary comes from the leading skippable frame, itself compressed or not; each
    frame is one record. Headers, lengths and payload digests are checked. A fault raises,
    or with ``strict=False`` ends its archive with a row whose ``error`` names it. Archives
    are read one per step; an archive is the unit that a task must hold.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"
    return archives.select("path", "content").mapInArrow(_read(payloads, strict), schema)


def stored_archives(pages: DataFrame, **options) -> DataFrame:
    """Archives written once to the shared folder, so that reading never builds them again."""
    return reliable_checkpoint(write_archives(pages, **options))
