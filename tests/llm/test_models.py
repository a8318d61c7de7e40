"""Language labels, quality rules and language-model scores."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import empty, rows, table
from pyspark.sql import functions as F

from tidemark.llm import gru, language, lm, quality

SF = "/root/testdata/sf0.001"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(9, 3)).astype(np.float32)
    sizes = [0, 5, 1, 4, 0, 2]
    codes, offsets = rng.integers(0, 9, sum(sizes)), np.concatenate([[0], np.cumsum(sizes)])
    got = language.viterbi(scores, codes, offsets, 0.8)
    import itertools
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        def value(path, a=a):
            return sum(scores[codes[a + i], p] for i, p in enumerate(path)) - 0.8 * sum(x != y for x, y in zip(path, path[1:], strict=False))
        if b > a:
            assert abs(value(got[a:b]) - max(map(value, itertools.product(range(3), repeat=b - a)))) < 1e-5


def test_mixed_text_and_scripts(spark):
    docs = table(spark)
    greek = spark.createDataFrame([(1000 + i, "και το με " * 20, "el") for i in range(20)], "doc_id BIGINT, text STRING, lang STRING")
    model = language.learn(docs.select("doc_id", "text", "lang").union(greek))
    text = "the thing and other with hand thing the other and " * 2 + "der nicht über schön groß und nicht der " * 3 + "και το με και το"
    found = language.identify(spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING"), model).first()
    assert [(s.lang, s.start, s.stop) for s in found.lang_spans] == [("en", 0, 20), ("de", 20, 44), ("el", 44, 49)]
    assert found.lang_pred == "de" and abs(found.score - 24 / 49) < 1e-9


def test_language_odd_rows(spark):
    docs = table(spark)
    got = {}
    for r in language.identify(docs, language.learn(docs)).collect():
        got.setdefault(r.doc.doc_id, []).append((r.lang_pred, r.score))
    assert sum(map(len, got.values())) == docs.count() and got[60] == got[61] == got[62] == got[65] == [("und", 0.0)]
    assert len(got[7]) == 3 and len(set(got[7])) == 1
    assert language.keep_identified(docs).columns == docs.columns
    none = language.learn(empty(spark))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"} and language.identify(empty(spark), none).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.op10_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)


def brute_counts(text):
    w = (text or "").encode().split()
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_quality_counts(spark):
    data = rows()
    rnd = random.Random(1)
    data += [(500 + i, "\n".join(rnd.choice(["a b c", "ä b\x0bc d", " ", "", "x|<é> #", "a b c a b c"]) for _ in range(30)), None, None, None, "", 0, "") for i in range(40)]
    docs = table(spark, data)
    model = quality.Model(np.zeros(0, int), [], [])
    got = quality.rate(docs, model).collect()
    assert len(got) == len(data)
    for r in got:
        n, *rest = brute_counts(r.doc.text)
        failed = n < 50 or 100 * rest[3] > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (n, *rest, failed, not failed)
    assert quality.rate(empty(spark), model).count() == 0


def test_quality_separates_labels(spark):
    got = quality.op9_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.95
    docs = table(spark)
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (3, 1)], "doc_id BIGINT, quality INT")
    one = quality.learn(docs, labels)
    assert one.probability(np.zeros(quality.SIZE)) > 0.99  # one class alone: nothing is judged bad


def test_gru_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in gru.start(seed=3).items()}
    codes = rng.integers(0, gru.HEAD + gru.BUCKETS, (6, 5))
    codes[2, 1] = 0

    def loss():
        h, total = np.zeros((5, gru.HIDDEN)), 0
        for c in codes:
            total -= gru.log_probs(p, h.copy(), c)[0].sum()
            h = gru.step(p, h, c)[0] * (c != 0)[:, None]
        return total
    trainer, got = gru.Trainer(p), {}
    trainer._adam = lambda g, s: got.update({k: v.copy() for k, v in g.items()})
    trainer._learn(codes, np.zeros((5, gru.HIDDEN)))
    for k, g in got.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[k][i] += 1e-5
        up = loss()
        p[k][i] -= 2e-5
        assert abs((up - loss()) / 2e-5 - g[i]) < 1e-4
        p[k][i] += 1e-5


def test_gru_scores_whole_texts():
    rng = np.random.default_rng(5)
    p = gru.start(seed=2)
    texts = [np.append(rng.integers(1, 2300, n), 0).astype(np.uint16) for n in (0, 3, 70, 33, 1)]
    for text, value in zip(texts, gru.score(p, texts), strict=True):
        h, total = np.zeros((1, gru.HIDDEN), np.float32), 0.0
        for c in text.astype(int):
            total += gru.log_probs(p, h, np.array([c]))[0][0]
            h, _ = gru.step(p, h, np.array([c]))
        assert abs(total / math.log(10) - value) < 1e-3 * max(1, abs(value))


def brute_base(data):
    tok = [(r[0], (r[1] or "").encode().lower().split() + [0]) for r in data]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in tok]
    c = collections.Counter(w for (i, t), h in zip(tok, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((i, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in t), 4))
                   for (i, t), h in zip(tok, held, strict=True)), key=str)


@pytest.mark.parametrize("sent", [lm.SENT, 5])
def test_lm_base_is_exact(spark, monkeypatch, sent):
    monkeypatch.setattr(lm, "SENT", sent)
    data = rows()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in lm.score(table(spark, data)).collect()]
    assert sorted(got, key=str) == brute_base(data)


def test_lm_learns(spark):
    got = lm.op7_lm_score(spark, SF).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.02 * got[2]
    assert lm.score(empty(spark)).count() == 0


def test_word_windows():
    from tidemark.llm.batches import batch_words, slices
    texts = pa.array([" a\tB\x0bc ", None, "", "é\xa0x \x1c", "a"])
    offsets, codes, distinct = batch_words(texts, True)
    words = [[distinct[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:], strict=False)]
    assert words == [t.encode().lower().split() if t else [] for t in texts.to_pylist()]
    batch = pa.RecordBatch.from_arrays([pa.array(["xx", None, "y" * 9, "", "z"])], ["text"])
    assert [b.num_rows for b in slices(batch, most=4)] == [2, 1, 2]


def test_oracle_sql_is_text():
    import __spark_entry__

    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())


def test_frequent_words_by_whole_classes_of_counts(spark):
    rows = [(f"w{i:04}", i, c) for i, c in enumerate([5000] + [900] * 3 + [7] * 40 + [1] * 300)]
    counted = spark.createDataFrame(rows, "word STRING, h BIGINT, c BIGINT")
    for most, n in ((0, 0), (1, 1), (3, 1), (4, 4), (43, 4), (44, 44), (343, 44), (344, 344), (10**6, 344)):
        got = lm.frequent(counted, most)
        assert [(r["word"], r["c"]) for r in got] == [(w, c) for w, _, c in rows[:n]], most
    assert lm.frequent(counted.limit(0), 5) == []
    plan = counted.filter(F.floor(F.log2(F.col("c")) * 256) >= 100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan


def test_training_leaves_no_code_out(monkeypatch):
    seen = []
    trainer = gru.Trainer(gru.start(seed=1))
    monkeypatch.setattr(trainer, "_learn", lambda codes, h: (seen.append(codes.size), h)[1])
    for n in (1, 63, 3201, 7001):
        seen.clear()
        trainer.streams(np.arange(n) % 5, 64)
        assert sum(seen) == n
    docs = [(i, f"one word {'more ' * (i % 50)}") for i in range(300)]
    learned = []
    monkeypatch.setattr(gru.Trainer, "streams", lambda self, codes, width: learned.append(len(codes)))
    monkeypatch.setattr(lm, "AT_ONCE", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array([np.zeros(len(t.split()) + 1, np.uint16).tobytes() for _, t in docs], pa.binary())], ["codes"])
    out = list(lm._train(gru.flat(gru.start(seed=1)))([batch, batch]))
    assert sum(learned) == 2 * sum(len(t.split()) + 1 for _, t in docs) == out[0].column("tokens")[0].as_py() and max(learned) < 1060


def test_batches_are_gathered_whole():
    batches = [pa.RecordBatch.from_arrays([pa.array([i, None]), pa.array([b"x" * i, b""], pa.binary())], ["doc_id", "codes"]) for i in range(1, 30)]
    got = list(lm.gathered(iter(batches), 100))
    assert 1 < len(got) < 29
    assert [x for b in got for x in b.column("codes").to_pylist()] == [x for b in batches for x in b.column("codes").to_pylist()]
    assert list(lm.gathered(iter([]), 5)) == []


def test_vocabulary_is_counted_in_batches(spark):
    texts = {0: "A b  a\tÄ ä b", 2: "", 3: None, 7: " \n", 9: "a\x0bb\x0cc\x1cc d e", None: "b Z"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")
    held = {r.doc_id for r in docs.filter(lm.held_out(F.col("doc_id"))).collect()}
    want = collections.Counter(w for k, t in texts.items() if k not in held for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    counted = lm.vocabulary(docs)
    assert {r["word"]: r["c"] for r in counted.collect()} == want and want["b"] > 2
    assert counted.filter(F.col("h") != F.xxhash64("word")).isEmpty()
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()
