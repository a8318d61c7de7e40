"""Token ids in Arrow files of equal-length sequences.

A file is a plain Arrow IPC file (also called the random-access or stream-file format). Its batches hold the same number
of rows, and a row is one sequence: ``ids`` and ``mask`` are fixed-size lists, so sequence i is row i % B of batch i // B
and its ids are a slice of one buffer that a memory map gives without copying or parsing. Documents lie end to end across
sequences; ``docs`` lists those that begin in a row. Only the last sequence of a file is padded, with mask 0.

Spark has no writer of raw bytes, but its text writer puts the bytes of a string column down as they are and ends each row
with a separator: a file's bytes without their closing magic are one row, the separator is the magic, and one row is one file.
So the files are written and committed by Spark into any store it reaches, and any Arrow reader opens them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import sliced
from tidemark.llm.common import read, running, stored
from tidemark.llm.packing import encode_texts, tokenizer_path
from tidemark.session import shared_dir

LENGTH = 2048  # ids of a sequence
ROWS = 256  # sequences of a batch
FILE_IDS = 1 << 21  # a file is closed by the document that brings it to so many ids
SLICE = 2 << 20  # bytes of text that are encoded at once
# Fixed value: the magic that an Arrow file ends with.
MAGIC = "ARROW1"

READ = "part int, number int, doc_id long, at long, n_tokens long, ids_crc32 long"


def schema(length: int, kind: pa.DataType, notes: dict[str, str] | None = None) -> pa.Schema:
    """Columns of a file with sequences of ``length`` ids; ``notes`` become the file's metadata."""
    return pa.schema([pa.field("ids", pa.list_(kind, length), False), pa.field("mask", pa.list_(pa.bool_(), length), False),
                      pa.field("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int32())])), False)], metadata=notes or {})


def file_bytes(doc_ids: list[int | None], texts: list[np.ndarray], kind: pa.DataType, length: int, rows: int, notes: dict[str, str]) -> pa.Buffer:
    """One file with the ids of the documents end to end; every document has at least one id."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    total, starts = int(sizes.sum()), np.cumsum(sizes) - sizes
    n = -(-total // length)
    ids, mask = np.zeros(n * length, kind.to_pandas_dtype()), np.zeros(n * length, bool)
    mask[:total] = True
    np.concatenate(texts, out=ids[:total], casting="same_kind")
    form = schema(length, kind, notes)
    first = np.searchsorted(starts, np.arange(n + 1) * length).astype(np.int32)  # the first document that begins in each row
    docs = pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array((starts % length).astype(np.int32))], fields=list(form.field("docs").type.value_type)))
    whole = pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length),
                                        docs.cast(form.field("docs").type)], schema=form)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, form) as out:
        for a in range(0, n, rows):
            out.write_batch(whole.slice(a, rows))
    return sink.getvalue()


class Sequences:
    """Random access to a file's sequences: views of the buffer (of a memory map, a downloaded object), nothing is copied."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        last = self.file.num_record_batches - 1
        self.n = last * self.rows + self.file.get_batch(last).num_rows if last >= 0 else 0

    def __len__(self) -> int:
        return self.n

    def batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """All ids and mask bits of batch ``k``, sequence after sequence."""
        b = self.file.get_batch(k)
        return b.column("ids").flatten().to_numpy(zero_copy_only=True), b.column("mask").flatten()

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids of sequence ``i`` and its mask, a bit for each id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        ids, mask = self.batch(i // self.rows)
        at = i % self.rows * self.length
        return ids[at:at + self.length], mask.slice(at, self.length)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, position of its first id in the file, ids) in order; a document in one batch is a view."""
        open_: tuple | None = None
        for k in range(self.file.num_record_batches):
            ids, mask = self.batch(k)
            ids, base = ids[:mask.true_count], k * self.rows * self.length
            docs = self.file.get_batch(k).column("docs")
            row = np.repeat(np.arange(len(docs)), np.diff(np.asarray(docs.offsets)))
            inner = docs.flatten()
            at = row * self.length + np.asarray(inner.field("at"))
            if open_ is not None:
                open_[2].append(ids[:at[0]] if len(at) else ids)
            stops = np.append(at[1:], len(ids)) if len(at) else at
            for doc_id, a, b in zip(inner.field("doc_id").to_pylist(), at, stops, strict=True):
                if open_ is not None:
                    yield self._closed(open_)
                open_ = (doc_id, base + int(a), [ids[a:b]])
        if open_ is not None:
            yield self._closed(open_)

    @staticmethod
    def _closed(doc: tuple) -> tuple[int | None, int, np.ndarray]:
        doc_id, at, parts = doc
        return doc_id, at, parts[0] if len(parts) == 1 else np.concatenate(parts)


def _files(path: str, end: int, kind: pa.DataType, length: int, rows: int, file_ids: int):
    """The files of a partition, one row each; it holds one open file and a slice of texts at a time."""
    def files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, held, number, part = [], [], 0, 0, None

        def closed():
            data = file_bytes(names, texts, kind, length, rows, {"part": str(part), "number": str(number)})
            ends = pa.py_buffer(np.array([0, data.size - len(MAGIC)], np.int32))
            return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), 1, [None, ends, data])], ["data"])  # the file itself, not a copy
        for batch in batches:
            part = batch.column("part")[0].as_py()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_texts(batch.column("text"), path, end), strict=True):
                names.append(doc_id)
                texts.append(ids.astype(kind.to_pandas_dtype()))
                held += len(ids)
                if held >= file_ids:
                    yield closed()
                    names, texts, held, number = [], [], 0, number + 1
        if names:
            yield closed()
    return files


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 1, length: int = LENGTH, rows: int = ROWS, file_ids: int = FILE_IDS) -> None:
    """Write the ids of all documents, in ascending order of ``doc_id``, as Arrow files below ``path``.

    Texts move once, to ranges of ids; each range is sorted, encoded and written in one pass. Ranges are cut by (doc_id, hash
    of the text, input position), so ids that many rows share, rows repeated and rows without id, which come last, are spread too.
    Every document is followed by the id ``end``; null and empty texts have it alone. An empty table writes no files.
    Other columns are not read. A file's metadata tells the range and its number there, which is the order of all files.
    """
    from tokenizers import Tokenizer

    tokenizer = tokenizer or tokenizer_path()
    kind = pa.uint16() if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else pa.uint32()
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("pos")]
    own = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text")).withColumn("pos", F.monotonically_increasing_id())
    ranged = own.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    files = ranged.mapInArrow(sliced(_files(tokenizer, end, kind, length, rows, file_ids), most=SLICE), "data binary")
    (files.select(F.col("data").cast("string").alias("value")).write
     .option("lineSep", MAGIC).option("maxRecordsPerFile", 1).option("compression", "none").text(path))


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content"):
            seq = Sequences(data.as_buffer())
            notes = seq.file.schema.metadata
            rows = [(doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc_id, at, ids in seq.documents()]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, int(notes[b"part"])), pa.int32()), pa.array(np.full(n, int(notes[b"number"])), pa.int32()),
                                              *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], [x.split()[0] for x in READ.split(", ")])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files below ``path``: part, number (the file), doc_id, at (position in the file), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    return files.select("content").mapInArrow(_documents, READ)


def encoded(docs: DataFrame, **options) -> DataFrame:
    """One row per document, read from the files written: doc_id, start, n_tokens, ids_crc32, file.

    ``start`` counts the ids of all documents before it. It is the position in the file and a running sum over files, of
    which only one sum for each range is brought together. See ``write`` for the order of ties and of rows without id.
    """
    path = shared_dir(docs.sparkSession, "token-files")
    write(docs, path, **options)
    found = stored(read_back(docs.sparkSession, path), "token-rows")
    files = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    begin = running(files.withColumn("all", F.lit(0)), ["all"], "part", [F.col("number")], F.col("n"), "begin").select("part", "number", "begin")
    return found.join(begin, ["part", "number"]).select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
                                                        F.concat_ws("/", "part", "number").alias("file"))


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents as token ids in Arrow files, read back."""
    return encoded(read(spark, sf_dir, "documents"))
