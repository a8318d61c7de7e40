"""Seekable Zstandard bundles of WARC records.

Records are grouped into frames that decompress on their own; a bundle ends with the seek table of the seekable
format (a skippable frame with the sizes of all frames). Frames are rows of a table, so bundles are written through
Spark to whatever store the cluster shares: the ``data`` of a bundle's rows in the order of ``frame``, put one after
the other, is its ``.warc.zst`` file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SALTS, read, spread_min, stored

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 30
# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAMES = ("bundle string, frame int, at long, raw_bytes int, data binary, "
          "records array<struct<page_id:long, offset:int, length:int>>")
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset int"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, raw) sizes of all frames."""
    body = b"".join(struct.pack("<II", c, r) for c, r in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """(compressed, raw) sizes from the last bytes of a bundle."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    body = tail[len(tail) - 9 - 8 * n:len(tail) - 9]
    return [struct.unpack_from("<II", body, 8 * i) for i in range(n)]


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record: response with its payload, or revisit with the HTTP head alone."""
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"Page-Id: {page_id}"] * (page_id is not None)
    if revisit:
        lines += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers} {digest}')}>", f"WARC-Profile: {REVISIT}", f"Refers-To-Page: {refers}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes, offset: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """Header fields, HTTP head, payload and the end of the record that starts at ``offset`` of a raw frame."""
    end = raw.index(b"\r\n\r\n", offset)
    first, *lines = raw[offset:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not the start of a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    start = end + 4
    stop = start + int(fields["Content-Length"])
    http = raw.index(b"\r\n\r\n", start) + 4
    return fields, raw[start:http], raw[http:stop], stop + 4


def _bundles(date: str, frame_bytes: int, bundle_bytes: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        schema = pa.schema([("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("raw_bytes", pa.int32()), ("data", pa.binary()),
                            ("records", pa.list_(pa.struct([("page_id", pa.int64()), ("offset", pa.int32()), ("length", pa.int32())])))])
        part, number, at, sizes, raw, index = TaskContext.get().partitionId(), 0, 0, [], bytearray(), []

        def row(data, n_raw, records):
            return pa.RecordBatch.from_pylist([{"bundle": f"part-{part:06d}-{number:03d}", "frame": len(sizes), "at": at, "raw_bytes": n_raw,
                                                "data": data, "records": records}], schema=schema)

        def flush():
            nonlocal at, raw, index
            data = press.compress(bytes(raw))
            out = row(data, len(raw), index)
            sizes.append((len(data), len(raw)))
            at, raw, index = at + len(data), bytearray(), []
            return out

        def close():
            nonlocal at, sizes, number
            out = row(seek_table(sizes), 0, [])
            at, sizes, number = 0, [], number + 1
            return out

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                page_id, url, html, size, sha, first, revisit = r
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                one = record(page_id, url, b"" if revisit else (html or "").encode(), size, digest, first, revisit, date)
                index.append({"page_id": page_id, "offset": len(raw), "length": len(one)})
                raw += one
                if len(raw) >= frame_bytes:
                    yield flush()
                    if at >= bundle_bytes:
                        yield close()
        if raw:
            yield flush()
        if sizes:
            yield close()
    return write


def write_bundles(pages: DataFrame, least: int = 0, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write one record per page below the shared folder and return the table of frames (bundle, frame, at, raw_bytes, data, records).

    Of pages with equal payloads of at least ``least`` bytes, the one with the smallest page_id is written whole and the
    others as revisits to it. A null html is an empty payload, a null url an empty target. Pages without an id are
    revisits where an equal payload has one; repeated rows of the smallest page_id are all written whole. An empty
    table gives no bundle. Digests come first, without the pages; groups of any size are salted in both steps, and a
    page moves once. ``records`` maps page_id to offset and length in the raw frame.
    """
    own = pages.select("page_id", "url", "html")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = own.withColumn("size", F.octet_length(payload).cast("long")).withColumn("sha", F.sha1(payload))
    digests = stored(keyed.select("page_id", "sha", "size"), "warc-digests")
    firsts = spread_min(digests.filter(F.col("size") >= least), "sha", "page_id", F.col("page_id"), "first")
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    present = digests.select("sha", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt")).distinct()
    joined = salted.join(present.join(firsts, "sha"), ["sha", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    ready = joined.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "size", "sha", "first", revisit.alias("revisit"))
    return stored(ready.mapInArrow(_bundles(date, frame_bytes, bundle_bytes), FRAMES), "warc-bundles")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
    lift = zstandard.ZstdDecompressor()
    for batch in batches:
        for bundle, frame, data, n_raw in zip(*[batch.column(c) for c in ("bundle", "frame", "data", "raw_bytes")], strict=True):
            if not n_raw.as_py():
                continue
            raw, offset, rows = lift.decompress(data.as_buffer(), max_output_size=n_raw.as_py()), 0, []
            while offset < len(raw):
                fields, head, payload, end = parse(raw, offset)
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"][5:]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
                page, to = fields.get("Page-Id"), fields.get("Refers-To-Page")
                rows.append((page and int(page), size, digest, kind, to and int(to), bundle.as_py(), frame.as_py(), offset))
                offset = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_bundles(frames: DataFrame) -> DataFrame:
    """All records of a table of frames, frame by frame, payload digests verified."""
    return frames.select("bundle", "frame", "data", "raw_bytes").mapInArrow(_read, READ)


def find_records(frames: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of the pages in ``ids`` (page_id): only the frames that hold one are decompressed."""
    wanted = frames.select("bundle", "frame", F.explode("records.page_id").alias("page_id")).join(ids.select("page_id").distinct(), "page_id", "leftsemi")
    hit = frames.join(wanted.select("bundle", "frame").distinct(), ["bundle", "frame"], "leftsemi")
    return read_bundles(hit).join(ids.select("page_id").distinct(), "page_id", "leftsemi")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as bundles and read back."""
    return read_bundles(write_bundles(read(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p),
b AS (SELECT *, [('0x' || substr(x, (i * 5 + 1)::INT, 5))::INT for i in range(8)] AS v FROM d)
SELECT page_id, payload_bytes, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n // s) % 32 + 1)::INT, 1)
    for s in [32768, 1024, 32, 1]], '') for n in v], '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM b"""
