"""Media columns in Matroska: EBML elements, clusters, lacing and cues as packet tables.

`mux` stores 8-bit mono samples as laced SimpleBlocks in clusters with cues; `parse` reads any
Matroska bytes into packets (track, timestamp, byte range), whatever the lacing (none, Xiph,
EBML, fixed-size), with unknown-size segments and clusters, and skips elements it does not know.

Null and empty bytes are a payload of blanks alone. Each row is handled for itself, so ties,
repeated rows, empty tables and other columns do not matter.
A text of any length is one file, muxed and parsed in time and memory in proportion to it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the Matroska format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1
RATE, CHANNELS, BIT_DEPTH, TIMESTAMP_SCALE, DURATION, DEFAULT_DURATION = 0xB5, 0x9F, 0x6264, 0x2AD7B1, 0x4489, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
MUXER, WRITER = 0x4D80, 0x5741

FRAME, FRAMES, BLOCKS, SAMPLE_RATE = 192, 32, 16, 8000
FRAME_MS = FRAME * 1000 // SAMPLE_RATE


class Packet(NamedTuple):
    track: int
    timestamp: int
    start: int
    length: int
    cluster: int


class Media(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    tracks: dict[int, str]
    clusters: int
    scale: int


def _size(n: int) -> bytes:
    """n as a variable-length size: the leading bits tell the length."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes | int) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def lace_sizes(sizes: list[int], lacing: int) -> bytes:
    """The lacing head of a block: number of frames less one, then what the lacing says of sizes."""
    head = bytes([len(sizes) - 1])
    if lacing == 1:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == 3:
        head += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = 1
            while not -(1 << 7 * width - 1) < b - a < (1 << 7 * width - 1):
                width += 1
            head += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return head


def block(frames: list[bytes], offset_ms: int, track: int = 1, lacing: int = 2) -> bytes:
    """A SimpleBlock; lacing 0 is none, 1 Xiph, 2 fixed-size, 3 EBML."""
    lacing = lacing if len(frames) > 1 else 0
    head = _size(track) + struct.pack(">hB", offset_ms, 0x80 | lacing << 1)
    return element(SIMPLE_BLOCK, head + (lace_sizes([len(f) for f in frames], lacing) if lacing else b"") + b"".join(frames))


_HEAD = element(EBML, element(DOC_TYPE, b"matroska") + element(DOC_VERSION, 4) + element(DOC_READ_VERSION, 2))
_TRACK = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(FLAG_LACING, 1) + element(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """payload (a multiple of 192 bytes) as the samples of one 8-bit PCM track."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * FRAME_MS)) + element(MUXER, b"quarry") + element(WRITER, b"quarry"))
    parts, place, cues = [info, _TRACK], len(info) + len(_TRACK), []
    for first in range(0, len(frames), FRAMES * BLOCKS):
        begin = first * FRAME_MS
        blocks_ = [element(TIMESTAMP, begin)]
        for i in range(first, min(len(frames), first + FRAMES * BLOCKS), FRAMES):
            blocks_.append(block(frames[i : min(i + FRAMES, first + FRAMES * BLOCKS)], (i - first) * FRAME_MS))
        cues.append(element(CUE_POINT, element(CUE_TIME, begin) + element(CUE_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, place))))
        parts.append(element(CLUSTER, b"".join(blocks_)))
        place += len(parts[-1])
    return _HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def _varint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """(value, place after it); keep: with the length marker, as in an id. A size of all ones is -1."""
    first = data[at]
    if not first:
        raise ValueError(f"no element at byte {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError("the data end within an element's head")
    value = int.from_bytes(data[at : at + width], "big")
    if keep:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int):
    """(id, body start, body end) of the elements between two places."""
    while at < end:
        kind, place = _varint(data, at, True)
        size, place = _varint(data, place, False)
        stop = end if size < 0 else place + size
        if stop > end:
            raise ValueError(f"element {kind:#x} at byte {at} goes beyond its parent")
        if size < 0 and kind == CLUSTER:  # ends where the next cluster or other top element begins
            stop = place
            while stop < end:
                inner, p = _varint(data, stop, True)
                if inner in (CLUSTER, CUES, TRACKS, INFO):
                    break
                n, p = _varint(data, p, False)
                stop = p + n
        yield kind, place, stop
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def frame_ranges(data: bytes, a: int, b: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, [(start, length)]) of the block body data[a:b]."""
    track, at = _varint(data, a, False)
    offset, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, offset, [(at, b - at)]
    n = data[at] + 1
    at += 1
    if lacing == 2:
        each, rest = divmod(b - at, n)
        if rest:
            raise ValueError("fixed-size lacing of unequal frames")
        return track, offset, [(at + i * each, each) for i in range(n)]
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at = _varint(data, at, False)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            raw = _uint(data, at, at + width) & (1 << 7 * width) - 1
            sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
            at += width
    sizes.append(b - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames go beyond their block")
    ranges = []
    for size in sizes:
        ranges.append((at, size))
        at += size
    return track, offset, ranges


def parse(data: bytes) -> Media:
    packets, cues, tracks, clusters, scale = [], [], {}, 0, 1_000_000
    durations: dict[int, int] = {}
    for kind, a, b in elements(data, 0, len(data)):
        if kind != SEGMENT:
            continue
        for top, c, d in elements(data, a, b):
            if top == INFO:
                for k, e, f in elements(data, c, d):
                    scale = _uint(data, e, f) if k == TIMESTAMP_SCALE else scale
            elif top == TRACKS:
                for _, e, f in elements(data, c, d):
                    found = {k: data[g:h] for k, g, h in elements(data, e, f)}
                    number = int.from_bytes(found.get(TRACK_NUMBER, b""), "big")
                    tracks[number] = found.get(CODEC_ID, b"").decode("ascii", "replace")
                    durations[number] = int.from_bytes(found.get(DEFAULT_DURATION, b""), "big")
            elif top == CLUSTER:
                begin = 0
                for k, e, f in elements(data, c, d):
                    if k == TIMESTAMP:
                        begin = _uint(data, e, f)
                    spans = [(e, f)] if k == SIMPLE_BLOCK else [(g, h) for i, g, h in elements(data, e, f) if i == BLOCK] if k == BLOCK_GROUP else []
                    for g, h in spans:
                        track, offset, ranges = frame_ranges(data, g, h)
                        step = durations.get(track, 0) // scale
                        packets += [Packet(track, begin + offset + i * step, s, n, clusters) for i, (s, n) in enumerate(ranges)]
                clusters += 1
            elif top == CUES:
                for _, e, f in elements(data, c, d):
                    time, where = 0, []
                    for k, g, h in elements(data, e, f):
                        if k == CUE_TIME:
                            time = _uint(data, g, h)
                        elif k == CUE_POSITIONS:
                            found = {i: _uint(data, m, n) for i, m, n in elements(data, g, h)}
                            where.append((found.get(CUE_TRACK, 0), found.get(CUE_CLUSTER, 0) + a))
                    cues += [(time, track, place) for track, place in where]
    return Media(packets, cues, tracks, clusters, scale)


def samples(media: bytes, parsed: Media, track: int = 1) -> bytes:
    """The bytes of a track's packets, in time order."""
    return b"".join(media[p.start : p.start + p.length] for p in sorted((p for p in parsed.packets if p.track == track), key=lambda p: p.timestamp))


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b" " * ((-len(data)) % FRAME or (0 if data else FRAME))


def feature(payload: bytes, parsed: Media) -> str:
    """Numbers of packets, clusters and cues, length in ms, and mean, deviation and sign changes of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    mean = total / n
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    end = max(p.timestamp for p in parsed.packets) + FRAME_MS
    return f"packets={len(parsed.packets)};clusters={parsed.clusters};cues={len(parsed.cues)};ms={end};mean={mean:.6f};dev={max(squares / n - mean * mean, 0) ** 0.5:.6f};crossings={crossings}"


def media_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                n, payload = padded(text)
                media = mux(payload)
                parsed = parse(media)
                back = samples(media, parsed)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, parsed)))
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def packet_table(media: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each packet of each row's Matroska bytes: key, track, codec, timestamp (ms), start, length, cluster, is_cued.

    Null and empty bytes have no packets.
    """

    def run(batches):
        for b in batches:
            keys, rows = [], []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not data:
                    continue
                m = parse(data)
                cued = {(t, track) for t, track, _ in m.cues}
                for p in m.packets:
                    keys.append(k)
                    rows.append((p.track, m.tracks.get(p.track, ""), p.timestamp * m.scale // 1_000_000, p.start, p.length, p.cluster, (p.timestamp, p.track) in cued))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, kinds))], [key, "track", "codec", "timestamp", "start", "length", "cluster", "is_cued"])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(run, f"{key} {kind}, track long, codec string, timestamp long, start long, length long, cluster long, is_cued boolean")
