"""WARC archives: whole round trips, single records by byte range, and every kind of page."""

import hashlib
import random

import pytest
import zstandard

from quarry.llm import warc


def words(draw, n):
    return " ".join(f"<p>word{draw.randrange(300)}</p>" for _ in range(n))


def test_archive_round_trip():
    draw = random.Random(1)
    records = [warc.record("response", f"urn:uuid:{i}", words(draw, draw.randint(1, 60)).encode(), {"X-Page-Id": str(i)}) for i in range(200)]
    dictionary = warc.trained(records)
    assert dictionary and zstandard.ZstdCompressionDict(dictionary).dict_id()
    data = warc.pack_archive(records, dictionary)
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D  # the dictionary leads, in a frame others skip
    found = list(warc.read_archive(data))
    assert [r for _, _, r in found] == records
    assert len(data) < len(warc.pack_archive(records, None))
    # Each record alone, from its byte range and the dictionary.
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    for (at, length, r) in found[::37]:
        assert alone.decompress(data[at : at + length]) == r
    # Without the dictionary they can't be read.
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(data[found[0][0] : found[0][0] + found[0][1]])
    # A dictionary that is not compressed, frames of many blocks, without size or checksum, and frames to skip.
    plain = (0x184D2A5D).to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    shared = zstandard.ZstdCompressionDict(dictionary)
    long_ = records[0] + bytes(random.Random(2).randbytes(700_000)) + b"a" * 500_000
    stream = zstandard.ZstdCompressor(dict_data=shared, write_content_size=False).compressobj()
    other = stream.compress(long_) + stream.flush()
    skip = (0x184D2A53).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    assert [r for _, _, r in warc.read_archive(plain + other + skip + zstandard.ZstdCompressor(dict_data=shared).compress(b"x"))] == [long_, b"x"]


def test_broken_archives():
    data = warc.pack_archive([b"a" * 1000], None)
    for bad in (data[:-1], data[:6], b"RIFF" + data, data + b"\0\0\0\0"):
        with pytest.raises(ValueError):
            list(warc.read_archive(bad))
    with pytest.raises(ValueError):
        warc.parse_record(b"HTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")


def test_too_little_to_train_on():
    assert warc.trained([]) is None and warc.trained([b"a"] * 3) is None
    assert list(warc.read_archive(warc.pack_archive([b"", b"b"], None)))[1][2] == b"b"


def expected(rows, least=100):
    first = {}
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", page)
    seen, out = set(), []
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        again = len(payload) >= least and (html or "") in seen
        seen.add(html or "")
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=repr)


def test_pages_of_every_kind(spark, tmp_path):
    draw = random.Random(4)
    long_ = "<b>ü</b>" * 400_000
    same = words(draw, 30)
    rows = [(i, f"http://e.example/{i}?q=a b\r\nX: y", words(draw, draw.randint(0, 40))) for i in range(300)]
    rows += [(1000 + i, "http://same.example/é", same) for i in range(150)] + [(900, None, same), (900, "u", same)]
    rows += [(None, "n", same), (None, None, None), (None, "m", "z" * 120), (None, "m", "z" * 120), (7, "", ""), (8, None, None), (9, "s", "x" * 99), (10, "s", "x" * 99), (11, "s", "x" * 100), (12, "s", "x" * 100), (13, "l", long_), (14, "l", long_)]
    draw.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, row string, size int").repartition(5)
    archives = warc.write_archives(df, archive_bytes=60_000, dict_bytes=4096, sample_bytes=50_000)
    assert archives.filter("raw_bytes > 60000 AND n_records > 1").count() == 0 and archives.count() > 5
    read = warc.read_archives(archives, with_payload=True)
    found = read.collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=repr) == expected(rows)
    assert all(r["intact"] for r in found) and len({r["record_id"] for r in found}) == len(rows)
    # Revisits give the payload of what they refer to; all texts come back.
    whole = warc.resolved(read).collect()
    assert sorted(((r["page_id"], bytes(r["payload"]).decode()) for r in whole), key=repr) == sorted(((p, h or "") for p, _, h in rows), key=repr)
    # The same from files.
    files = warc.save_files(archives, str(tmp_path / "out")).collect()
    assert len(files) == archives.count()
    again = warc.read_archives(warc.archive_files(spark, str(tmp_path / "out"))).collect()
    assert sorted((r["record_id"], r["start"], r["payload_digest"]) for r in again) == sorted((r["record_id"], r["start"], r["payload_digest"]) for r in found)
    assert {r["url"] for r in found if r["page_id"] == 3} == {"http://e.example/3?q=a%20b%0D%0AX:%20y"}


def test_empty_pages(spark):
    archives = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert archives.count() == 0 and warc.read_archives(archives).count() == 0
