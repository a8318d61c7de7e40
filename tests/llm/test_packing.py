import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import empty, table
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import packing

ODD = ["", " ", "a\x1cb it's I'LL don't <|endoftext|> x", "Éé’s ÀÀ é İI ΣΑΣ ß ﬁ 12a3.4  x　y, 你好! +1 (2) ;:?!", "ª º × ÷ µ½ z", "A.!! b--c ''", "a<|endoftext|>b <|STARTOFTEXT|>c.<|startoftext|> <|endoftext|>", None]


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(packing.tokenizer_path())


def test_ids_are_the_tokenizers(full):
    texts = [*ODD, "Word, word! WORD other.*** other&&& (x)"]
    got = packing.encode_texts(pa.array(texts), packing.tokenizer_path())
    assert [x.tolist() for x in got] == [full.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_knapsack():
    import itertools
    rng = np.random.default_rng(1)
    lengths, most = np.array([3, 5, 7, 11]), np.array([2, 9, 1, 3])
    for _ in range(20):
        worth = rng.random(4)
        best = max(sum(c * w for c, w in zip(n, worth, strict=True)) for n in itertools.product(*[range(m + 1) for m in most]) if np.dot(n, lengths) <= 24)
        copies = packing.heaviest(lengths, worth, most, 24)
        assert (copies <= most).all() and np.dot(copies, lengths) <= 24 and abs(np.dot(copies, worth) - best) < 1e-9


def test_the_program_carries_a_real_histogram(spark, full):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    sizes = [len(x) for x in packing.encode_texts(pa.array(texts), packing.tokenizer_path())]
    pieces = np.array([n for s in sizes for n in [4096] * (s // 4096) + [s % 4096] * (s % 4096 > 0)])
    lengths, counts = np.unique(pieces, return_counts=True)
    some = lengths < 4096
    lengths, counts = lengths[some], counts[some]
    got = packing.program(lengths, counts, 4096)
    used = np.zeros(len(lengths), np.int64)
    for idx, copies, times in got:
        assert times >= 1 and 0.9995 * 4096 <= (lengths[idx] * copies).sum() <= 4096
        used[idx] += copies * times
    assert (used <= counts).all() and (lengths * used).sum() >= 0.8 * (lengths * counts).sum()
    whole = packing.plan(*np.unique(pieces, return_counts=True))
    assert sum(t for _, t in whole) <= -(-int(pieces.sum()) // 4096) + 1


@pytest.mark.parametrize("lengths,counts", [([4096], [5]), ([2048, 1365, 2731, 4096], [10, 30, 30, 4]), (list(range(100, 900)), [3] * 800), ([2049], [7]), ([], [])])
def test_plan_uses_each_piece_once(lengths, counts):
    got = packing.plan(np.array(lengths), np.array(counts))
    used = {}
    for pattern, times in got:
        assert sum(n * c for n, c in pattern) <= 4096 and times > 0
        for n, c in pattern:
            used[n] = used.get(n, 0) + c * times
    assert used == dict(zip(lengths, counts, strict=True))
    sequences = sum(t for _, t in got)
    bound = max(-(-int(np.dot(lengths, counts)) // 4096), sum(c for n, c in zip(lengths, counts, strict=True) if n > 2048))
    assert sequences <= bound + 1


def test_pack(spark, full):
    df = table(spark)
    got = packing.pack(df).collect()
    want = []
    for r in df.collect():
        ids = full.encode(r.text or "", add_special_tokens=False).ids + [1]
        want += [(r.doc_id, k, a, len(ids[a:a + 4096]), zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    seq = {}
    for r in got:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(seq) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack(empty(spark)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("size", F.lit("x"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "pii", "mixing", "packing"]
    from test_dedup import brute_components
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out = spark.createDataFrame(out.collect(), out.schema)
        assert out.dtypes == docs.dtypes
        before, after = [r.doc_id for r in docs.collect()], [r.doc_id for r in out.collect()]
        if name == "language_id":
            assert len(after) > 0.98 * len(before)
        elif name == "near_dedup":
            comp = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5)
            assert sorted(after) == sorted({c for _, c in comp.values()})
        elif name == "pii":
            assert sorted(after) == sorted(before) and out.filter("text RLIKE '[a-z0-9]@[a-z0-9]+[.]'").count() == 0
        else:
            assert set(after) <= set(before) and max(after.count(i) for i in set(after)) <= 3
        docs = out
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted(r.doc_id for r in got if r.piece == 0) == sorted(after)
