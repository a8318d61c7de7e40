import base64
import hashlib

import pytest
import zstandard

from tidemark.llm import warc

SCHEMA = "page_id BIGINT, url STRING, html STRING, first BIGINT, salt STRING"


@pytest.fixture(scope="module")
def pages(spark):
    data = [(i, f"http://x/{i}?q=é b", ["<p>one</p>", "<p>two</p>", None, "", "z" * 5000 + str(i), "\r\n\r\nWARC/1.1"][i % 6], 1, "s") for i in range(60)]
    return spark.createDataFrame([*data, data[7], data[7], (None, None, "<p>one</p>", None, None), (None, "u\nv", "alone", None, None)], SCHEMA)


def test_round_trip(spark, pages):
    frames = warc.write_bundles(pages, frame_bytes=4000, bundle_bytes=3000)
    got = sorted(map(tuple, warc.read_bundles(frames).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for p, h in rows:
        if p is not None:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, h in rows:
        to = first.get(h)
        revisit = to is not None and p != to
        want.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    assert got == sorted(want, key=str)


def test_bundles_are_seekable(spark, pages):
    frames = warc.write_bundles(pages, frame_bytes=4000).orderBy("bundle", "frame").collect()
    files = {}
    for f in frames:
        assert f.at == len(files.get(f.bundle, b""))
        files[f.bundle] = files.get(f.bundle, b"") + bytes(f.data)
    index = {(f.bundle, f.frame): f.records for f in frames}
    for name, data in files.items():
        raw = b"".join(zstandard.ZstdDecompressor().decompress(bytes(f.data), max_output_size=f.raw_bytes) for f in frames if f.bundle == name and f.raw_bytes)
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == raw
        at = 0
        for k, (packed, size) in enumerate(warc.read_seek_table(data)):
            one = zstandard.ZstdDecompressor().decompress(data[at:at + packed], max_output_size=size)
            assert len(one) == size
            for r in index[name, k]:
                fields, _, _, end = warc.parse(one, r.offset)
                assert fields.get("Page-Id", "None") == str(r.page_id) and end == r.offset + r.length
            at += packed


def test_search_small_payloads_and_empty(spark, pages):
    frames = warc.write_bundles(pages, least=12)
    assert {r.record_type for r in warc.read_bundles(frames).filter("payload_bytes < 12").collect()} == {"response"}
    ids = spark.createDataFrame([(4,), (9,), (999,)], "page_id BIGINT")
    assert sorted(r.page_id for r in warc.find_records(frames, ids).collect()) == [4, 9]
    assert warc.read_bundles(warc.write_bundles(pages.limit(0))).count() == 0
