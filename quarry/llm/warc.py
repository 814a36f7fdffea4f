"""WARC archives compressed by Zstandard with a dictionary of their own.

Each archive (.warc.zst) starts with a skippable frame that holds a dictionary trained on the archive's own records; then every
record is a frame of its own, compressed with that dictionary, so any record can be read alone from its byte range.
An archive holds records of about `archive_bytes` bytes before compression, and one record at least; a task has one in memory.
The dictionary is trained on records taken at even steps from the whole archive, `sample_bytes` of them; it sets how well
records compress, nothing else. Records too few or too small to train on are compressed without one, and the leading frame is then missing.

Of rows whose payloads are equal and have at least `least` bytes the one with the smallest page_id (null: after all others; then the first
row) becomes a response, the others revisit records that name it. Payloads are compared by SHA-256. Digests and ids are shuffled for that, and a payload
that very many rows have is one aggregated row, met by a join that Spark's adaptive execution can split. Pages themselves are written once with a row
number and cross one shuffle, by that number.

Null html is an empty payload; a null or empty url gives a record without target; control characters, blanks and others outside ASCII are escaped in it. Repeated rows are
pages of their own: one of them is the response. Html of any length is one record. An empty table gives no archive. Columns other than page_id, url
and html do not matter.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import tidy, written

# Fixed values of the formats: frame magics, the first of sixteen skippable ones, the dictionary's own, record names and the revisit profile.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"

ARCHIVE_BYTES, DICT_BYTES, SAMPLE_BYTES, LEVEL, LEAST = 16 << 20, 32 << 10, 2 << 20, 6, 100
#: Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"


def record(kind: str, record_id: str, block: bytes, fields: dict[str, str | None], date: str = DATE) -> bytes:
    """One WARC record; fields that are None are left out."""
    told = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, **fields, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {v}\r\n" for k, v in told.items() if v is not None)
    return b"".join([VERSION, b"\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"])


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields with lower-case names, block) of a record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    length = int(fields["content-length"])
    if len(rest) < length:
        raise ValueError("the record ends before its block does")
    return fields, rest[:length]


def response_head(length: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length


def parse_response(block: bytes) -> tuple[dict[str, str], bytes]:
    """(HTTP header fields with lower-case names, body) of a response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    pairs = (line.decode("latin-1").partition(":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, body


def target(url: str | None) -> str | None:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") or None if url else None


def trained(records: list[bytes], dict_bytes: int = DICT_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes | None:
    """A dictionary from records taken at even steps, or None where there is too little to learn from."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // sample_bytes))
    sample = records[::step]
    # A long record gives its first bytes as one sample of many; the dictionary is the better for many short ones.
    sample = [r[a : a + 8192] for r in sample for a in range(0, len(r), 8192)]
    size = min(dict_bytes, sum(map(len, sample)) // 8)
    if len(sample) < 8 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, sample, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return None


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard or skippable frame at `at` ends, from its block heads alone."""
    magic = int.from_bytes(data[at : at + 4], "little")
    if magic & ~0xF == SKIPPABLE:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    elif magic == FRAME and at + 5 <= len(data):
        told = data[at + 4]
        single = told >> 5 & 1
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[told & 3] + (single, 2, 4, 8)[told >> 6]
        last = False
        while not last:
            head = int.from_bytes(data[end : end + 3], "little")
            if end + 3 > len(data) or head >> 1 & 3 == 3:
                raise ValueError(f"broken frame at byte {at}")
            last = bool(head & 1)
            end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        end += 4 * (told >> 2 & 1)
    else:
        raise ValueError(f"no frame at byte {at}")
    if end > len(data):
        raise ValueError(f"the data end within the frame at byte {at}")
    return end


def pack_archive(records: list[bytes], dictionary: bytes | None, level: int = LEVEL) -> bytes:
    """The archive: a leading skippable frame with the dictionary, compressed itself, then each record as a frame."""
    import zstandard

    out = []
    if dictionary:
        body = zstandard.ZstdCompressor(level=19).compress(dictionary)
        out.append(DICTIONARY.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body)
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared is not None:
        shared.precompute_compress(level)
        compressor = zstandard.ZstdCompressor(dict_data=shared, write_checksum=True)
    else:
        compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
    out.extend(compressor.compress(r) for r in records)
    return b"".join(out)


def read_archive(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(first byte, length, record) of every record of an archive, with or without a dictionary, compressed or not."""
    import zstandard

    decompressor = zstandard.ZstdDecompressor()
    at = 0
    while at < len(data):
        end = frame_end(data, at)
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic == DICTIONARY and at == 0:
            body = data[8:end]
            if int.from_bytes(body[:4], "little") == FRAME:
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
        elif magic == FRAME:
            yield at, end - at, decompressor.decompressobj().decompress(data[at:end])
        at = end


def staged(pages: DataFrame) -> DataFrame:
    """row, page_id, url, html, digest, size of every page, written once so that row numbers hold."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    return written(rows.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("size")), "pages", "zstd")


def revisits(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """row, and first (row, page_id, url of the response it refers to), of every row of `staged` that becomes a revisit."""
    own = rows.filter(F.col("size") >= least)
    first = F.min(F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "row", "url")).alias("first")
    groups = own.groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n")
    # Written, so that the join has a shuffle of its own on both sides, which Spark can split where a payload is frequent.
    groups = written(groups, "payloads")
    return own.select("row", "digest").join(groups, "digest").filter(F.col("row") != F.col("first.row")).select("row", "first")


def write_archives(pages: DataFrame, name: str = "pages", archive_bytes: int = ARCHIVE_BYTES, dict_bytes: int = DICT_BYTES, sample_bytes: int = SAMPLE_BYTES, level: int = LEVEL, least: int = LEAST, date: str = DATE) -> DataFrame:
    """archive (a name ending in .warc.zst), n_records, raw_bytes, dict_bytes and content of the archives of all pages."""
    rows = staged(pages)
    told = rows.join(revisits(rows, least), "row", "left").select("row", "page_id", "url", "html", "digest", *(F.col(f"first.{c}").alias(f"first_{c}") for c in ("row", "page_id", "url")))

    def named(row: int) -> str:
        return "urn:uuid:" + str(uuid.UUID(bytes=hashlib.md5(f"{name}/{row}".encode()).digest(), version=4))

    def records(b: pa.RecordBatch) -> Iterator[bytes]:
        for row, page, url, html, digest, first, first_page, first_url in zip(*(c.to_pylist() for c in b.columns)):
            payload = html.encode()
            fields = {"WARC-Target-URI": target(url), "X-Page-Id": None if page is None else str(page), "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": HTTP}
            head = response_head(len(payload))
            if first is None:
                yield record("response", named(row), head + payload, fields, date)
            else:
                fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{named(first)}>", "WARC-Refers-To-Target-URI": target(first_url), "WARC-Refers-To-Date": date, "X-Refers-To-Page-Id": None if first_page is None else str(first_page)}
                yield record("revisit", named(row), head, fields, date)

    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = k = 0

        def closed() -> pa.RecordBatch:
            title = f"{name}-{part:06d}-{k:05d}.warc.zst"
            info = record("warcinfo", "urn:uuid:" + str(uuid.UUID(bytes=hashlib.md5(title.encode()).digest(), version=4)), b"format: WARC File Format 1.1\r\n", {"WARC-Filename": title, "Content-Type": "application/warc-fields"}, date)
            dictionary = trained(held, dict_bytes, sample_bytes)
            content = pack_archive([info, *held], dictionary, level)
            return pa.RecordBatch.from_arrays([pa.array([title]), *(pa.array([v], pa.int64()) for v in (len(held), size, len(dictionary or b""))), pa.array([content], pa.binary())], ["archive", "n_records", "raw_bytes", "dict_bytes", "content"])

        for b in batches:
            for r in records(b):
                if held and size + len(r) > archive_bytes:
                    yield closed()
                    held, size, k = [], 0, k + 1
                held.append(r)
                size += len(r)
        if held:
            yield closed()

    return written(told.mapInArrow(tidy(run), "archive string, n_records long, raw_bytes long, dict_bytes long, content binary"), "archives")


def save_files(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as a file into a folder that all executors share by that path; returns path and size of each."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            paths = []
            for title, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = os.path.join(folder, title)
                own = f"{path}.{uuid.uuid4().hex}"
                with open(own, "wb") as f:
                    f.write(content)
                os.replace(own, path)  # a task that runs again puts the same bytes there
                paths.append((path, len(content)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in paths], pa.string()), pa.array([n for _, n in paths], pa.int64())], ["path", "size"])

    return archives.select("archive", "content").mapInArrow(tidy(run), "path string, size long")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """archive (the file's path) and content of the .warc.zst files at path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.col("path").alias("archive"), "content")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every response and revisit record of archives (archive, content): where it lies, its names and its payload's size and digest.

    A response's size and digest are those of the bytes read, and intact says whether they agree with its header; a revisit's are those
    its header tells of the payload it refers to. payload is null for revisits (`resolved` puts it in).
    """
    schema = "archive string, start long, length long, record_type string, record_id string, page_id long, url string, payload_bytes long, payload_digest string, refers_to_id string, refers_to long, intact boolean"
    schema += ", payload binary" * with_payload
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[f.split(" ")[1]] for f in schema.split(", ")]

    def rows(title: str, content: bytes) -> Iterator[tuple]:
        for at, length, data in read_archive(content):
            fields, block = parse_record(data)
            kind = fields["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            http, body = parse_response(block)
            told = fields.get("warc-payload-digest", "").removeprefix("sha256:")
            page, other = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
            if kind == "response":
                size, digest = len(body), hashlib.sha256(body).hexdigest()
                intact = digest == told and size == int(http.get("content-length", -1))
            else:
                size, digest, intact = int(http["content-length"]), told, not body
            row = (title, at, length, kind, fields["warc-record-id"].strip("<>"), None if page is None else int(page), fields.get("warc-target-uri"), size, digest, fields.get("warc-refers-to", "").strip("<>") or None, None if other is None else int(other), intact)
            yield row + (body if kind == "response" else None,) * with_payload

    def run(batches):
        for b in batches:
            for title, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held, size = [], 0
                for row in rows(title, content):
                    held.append(row)
                    size += row[7] if with_payload else 256
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    return archives.select("archive", "content").mapInArrow(tidy(run), schema)


def resolved(records: DataFrame) -> DataFrame:
    """records (read with_payload) in which every revisit has the payload of the response it refers to."""
    held = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("payload").alias("held"))
    found = records.join(held, "refers_to_id", "left")
    return found.select(*(F.coalesce("payload", "held").alias("payload") if c == "payload" else c for c in records.columns))
