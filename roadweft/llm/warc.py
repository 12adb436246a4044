"""WARC archives with dictionary-compressed records.

Each archive opens with a skippable frame that holds a Zstandard dictionary trained on the
archive's own records; every record is a frame of its own, so it can be read alone. Archives are
bounded in size, so a writer never holds more than one of them. Equal payloads are stored once:
the record of the smallest id is the response, others revisit it.

A writing task names its archives by a fresh uuid and reports them in a table; only archives that
the table names are read, so files left by lost or repeated tasks do no harm. Files are opened
through pyarrow's file systems, by the scheme of the folder.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweft.llm.arrow import bounded
from roadweft.llm.columns import named
from roadweft.session import exists, materialize, passing, scratch

ARCHIVE_BYTES = 8 << 20
DICT_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20
PIECE_BYTES = 16 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the WARC Zstandard format: magic numbers of the dictionary's frame and of a frame.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target_uri string"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:roadweft:page:{'none' if page_id is None else page_id}:{digest}>"


def _page_id(record_id: str) -> int | None:
    at = record_id.strip("<>").split(":")[3]
    return None if at == "none" else int(at)


def _head(first: str, fields: list[tuple[str, str]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Refers-To-Date", DATE)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head("WARC/1.1", fields) + block + b"\r\n\r\n"


def samples_of(records: list[bytes], limit: int = SAMPLE_BYTES) -> list[bytes]:
    """Pieces of the archive's records, spread evenly over its bytes, of about ``limit`` bytes in
    all. Long records give several pieces, and a small archive small ones, so that there are enough
    to learn from however large or few the records are."""
    total = sum(map(len, records))
    size = max(8, min(PIECE_BYTES, total // 128))
    step, seen, pieces = max(1, total // limit), 0, []
    for record in records:
        for at in range(0, len(record), size):
            if seen % step == 0 and len(record) - at >= 8:
                pieces.append(record[at : at + size])
            seen += 1
    return pieces


def train(records: list[bytes], size: int = DICT_BYTES, limit: int = SAMPLE_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on pieces of the records. Where those are too few or too uniform for the
    trainer, the pieces themselves are the dictionary (raw content)."""
    pieces = samples_of(records, limit)
    try:
        return zstandard.train_dictionary(max(256, min(size, sum(map(len, pieces)) // 4)), pieces)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(pieces)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack_archive(records: list[bytes]) -> bytes:
    """The archive's bytes: dictionary frame, warcinfo, one frame per record."""
    info = b"software: roadweft\r\nformat: WARC File Format 1.1\r\n"
    first = _head("WARC/1.1", [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n"
    words = train(records)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(words.as_bytes())
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(packed)), packed, *(squeeze.compress(r) for r in [first, *records])])


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by its block headers."""
    head = bytes(data[at : at + 18])
    checked = zstandard.get_frame_parameters(head).has_checksum
    at += zstandard.frame_header_size(head)
    last = False
    while not last:
        word = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = bool(word & 1), word >> 1 & 3, word >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * checked


def unpack_archive(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    data, at = memoryview(raw), 0
    expand = zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack("<II", data[at : at + 8])
        if magic == DICT_MAGIC:
            packed = bytes(data[at + 8 : at + 8 + size])
            words = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == FRAME_MAGIC else packed
            expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            at += 8 + size
        elif 0x184D2A50 <= magic <= 0x184D2A5F:  # other skippable frames
            at += 8 + size
        else:
            end = _frame_end(data, at)
            yield expand.decompress(bytes(data[at:end]))
            at = end


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def parse(record: bytes) -> dict | None:
    """A row of READ from a record; None for records that hold no page. Checks lengths and digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_fields(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    uri = fields.get("warc-target-uri")
    return {
        "page_id": _page_id(fields["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_id(fields["warc-refers-to"]) if kind == "revisit" else None,
        "target_uri": uri,
    }


def write(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, folder: str | None = None
) -> DataFrame:
    """Write one record per row; returns the written table of archives: path, records, bytes.

    The archives go to ``folder``, which all executors share; without one to a scratch folder that
    is deleted when the application ends.

    Of rows with equal payloads of at least ``min_bytes`` the smallest id is the response and
    others revisit it; smaller payloads are all responses. Defined cases: a null payload is empty;
    a null id is never the smallest if another exists, and revisits it; repeated rows that share
    the smallest id are responses all; a null URL has no Target-URI and control characters and
    blanks in URLs are percent-encoded; an empty table writes nothing; other columns are not read.
    """
    spark = pages.sparkSession
    bounded(spark)
    lasts, folder = folder is not None, (folder or scratch(spark, "warc")).rstrip("/")
    slim = pages.select(named(page_id).cast("bigint").alias("id"), named(url).cast("string").alias("url"), F.coalesce(named(payload).cast("string"), F.lit("")).alias("payload"))
    keyed = slim.withColumn("digest", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    copies = (
        keyed.filter(F.octet_length("payload") >= min_bytes)
        .groupBy(F.col("digest").alias("same"))
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    # the hint keeps one plan at every size; adaptive execution splits payloads that many share
    rows = keyed.join(copies.hint("merge"), F.col("digest") == F.col("same"), "left").select("id", "url", "payload", "first")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            name, data = f"{uuid.uuid4().hex}.warc.zst", pack_archive(held)
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(held)], "bytes": [len(data)]})

        for batch in batches:
            for i, u, p, first in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(_record(i, u, p.encode(), first, first is not None and first != i))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    written = materialize(rows.mapInArrow(archives, "path string, records bigint, bytes bigint"), "warc-archives")
    if not lasts and exists(spark, folder):
        passing(spark, folder)
    return written


def read(archives: DataFrame) -> DataFrame:
    """The page records of written archives (path, ...), as rows of READ.

    Defined cases: lengths and digests are checked and a damaged record is an error; a record
    without a URL has a null target_uri; records that hold no page (warcinfo) give no row; records
    come as often as they were written; a table of no archives gives an empty result; other columns
    are not read. A task holds one archive."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ.split(", ")]
        kinds = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type", "target_uri") else pa.int64()) for n in names])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at) as source:
                    rows = [r for r in map(parse, unpack_archive(source.read())) if r]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    spread = archives.select("path").repartition(max(1, min(archives.count(), 4 * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    return spread.mapInArrow(records, READ)
