import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import empty, rows, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, token_files
from tidemark.session import shared_dir


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(packing.tokenizer_path())


def brute(data, plain):
    out, at = [], 0
    for doc_id, ids in sorted(((r[0], plain.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in data), key=lambda x: (x[0] is None, x[0] or 0)):
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_equal_the_tokenizer(spark, plain):
    data = [*rows(), (-(1 << 62), "far <|endoftext|> away", "en", "a", 1, "", 0, ""), (1 << 62, None, "en", "a", 1, "", 0, "")]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.encoded(table(spark, data), length=64, rows=4, file_ids=3000).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(data, plain)
    assert token_files.encoded(empty(spark)).count() == 0


def test_one_id_on_many_rows(spark, plain):
    data = [(5, f"text {i % 7} end", "en", "a", 1, "", 0, "") for i in range(300)] + [(i, "x y", "en", "a", 1, "", 0, "") for i in range(10)]
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.encoded(table(spark, data)).collect())
    assert [d for _, d, _ in got] == sorted(r[0] for r in data)
    assert [s for s, _, _ in got] == np.cumsum([0, *[n for _, _, n in got][:-1]]).tolist()


def test_any_reader_opens_the_files(spark, plain):
    df = table(spark)
    path = shared_dir(spark, "token-test")
    token_files.write(df, path, length=32, rows=8, file_ids=2000)
    found = spark.read.format("binaryFile").load(path).select("path").collect()
    total, stream = 0, []
    for r in sorted(found, key=lambda r: r.path):
        with pa.memory_map(r.path.removeprefix("file:")) as source:
            seq = token_files.Sequences(source)
            before = pa.total_allocated_bytes()
            for i in range(len(seq)):
                ids, mask = seq[i]
                assert len(ids) == len(mask) == 32 and not ids.flags.owndata and not ids.flags.writeable
                assert i + 1 == len(seq) or mask.true_count == 32
                real = mask.to_numpy(zero_copy_only=False)
                assert not ids[~real].any()
                stream += ids[real].tolist()
            assert pa.total_allocated_bytes() - before < 1 << 12  # views only
            assert [b.num_rows for b in (seq.file.get_batch(k) for k in range(seq.file.num_record_batches - 1))] == [8] * (seq.file.num_record_batches - 1)
            total += sum(len(x) for _, _, x in seq.documents())
    want = [plain.encode(r.text or "", add_special_tokens=False).ids + [1] for r in df.orderBy(F.col("doc_id").asc_nulls_last()).collect()]
    assert len(found) > 3 and total == len(stream) == sum(map(len, want)) and stream == [i for x in want for i in x]


def test_wide_ids_and_random_access():
    texts = [np.arange(n, dtype=np.uint32) + 70_000 for n in (1, 5, 100, 3)]
    data = token_files.file_bytes([1, None, 3, 4], texts, pa.uint32(), 8, 2, {"part": "0", "number": "0"})
    seq = token_files.Sequences(data)
    assert len(seq) == 14 and seq[13][1].true_count == 109 - 13 * 8
    assert [(d, a, x.tolist()) for d, a, x in seq.documents()] == [(d, a, x.tolist()) for d, a, x in zip([1, None, 3, 4], [0, 1, 6, 106], texts, strict=True)]
    with pytest.raises(IndexError):
        seq[14]


def test_few_encodings_are_held_at_once(plain):
    class Counted:
        most = 0

        def encode_batch_fast(self, texts, **options):
            self.most = max(self.most, len(texts))
            return plain.encode_batch_fast(texts, **options)
    counted, texts = Counted(), [f"word {i} é" for i in range(3 * packing.AT_ONCE + 5)]
    got = packing.encode_in_parts(counted, texts)
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert counted.most == packing.AT_ONCE
