import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import empty, rows, table

from tidemark.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(data, items, k):
    docs = [(i, Counter(terms(t))) for i, t in data if terms(t)]
    n, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = {}
    for item in {i for i, _ in items}:
        asked = Counter(t for i, text in items if i == item for t in terms(text))
        scored = []
        for doc_id, c in docs:
            m = 75 + 25 * sum(c.values()) * n // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out[item] = [(rank + 1, d, -s) for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return {i: sorted(x) for i, x in out.items()}


def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünter", "é1", "中文"]
    share = [1 / (i + 1) for i in range(len(vocabulary))]
    data = [(i, " ".join(rnd.choices(vocabulary, share, k=rnd.choice([3, 30, 300])))) for i in range(700)]
    data += [(1000 + i, data[3][1].upper()) for i in range(60)]  # ties past the end of a list
    return data, [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([1, 8, 40])))) for i in range(30)] + [(0, data[3][1]), (77, "..."), (78, None), (None, "w1 W1 w7")]


def test_lists_equal_brute_force(spark):
    data, items = corpus()
    data = [*data, *((r[0], r[1]) for r in rows())]
    docs = table(spark, [(i, t, "en", "a", 1, "x", 1, "s") for i, t in data])
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id BIGINT, text STRING, score STRING")
    want = {i: x for i, x in brute(data, items, 20).items() if x}
    assert found(ranked.search(docs, asked)) == want and len(want[0]) == 20
    got = found(ranked.search(docs.limit(7), asked, k=3))
    assert all(len(x) <= 3 for x in got.values())


def test_blocks_of_items(spark, monkeypatch):
    data, items = corpus()
    monkeypatch.setattr(ranked, "PAIRS", 100)
    docs = table(spark, [(i, t, "en", "a", 1, "x", 1, "s") for i, t in data[:200]])
    asked = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    assert found(ranked.search(docs, asked)) == {i: x for i, x in brute(data[:200], items, 20).items() if x}


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "w1 w2")], "item_id BIGINT, text STRING")
    assert ranked.search(empty(spark), items).count() == 0
    assert ranked.search(table(spark), items.limit(0)).count() == 0
    assert ranked.search(table(spark), items).count() == 0  # no document has the terms


def test_bounds_lose_nothing_and_prune():
    rng = np.random.default_rng(2)
    size, n = 40, 500
    dense = np.where(rng.random((n, size)) < 0.2, rng.integers(1, 900_000, (n, size)), 0)
    dense[:, 0] = rng.integers(1, 900_000, n)  # a term that every vector has
    weights = rng.integers(1, 9000, size)
    weights[0] = 1
    row, terms_ = np.nonzero(dense)
    at = np.searchsorted(row, np.arange(n + 1))
    norms = np.sqrt((weights * dense.astype(float) ** 2).sum(axis=1))
    bucket = ranked.Bucket(at, terms_, dense[row, terms_], norms, size)
    for _ in range(20):
        own = np.sort(rng.choice(size, 8, replace=False))
        own[0] = 0
        counts = rng.integers(1, 3, 8)
        weighted = np.zeros(size, np.int64)
        weighted[own] = counts * weights[own]
        score = dense @ weighted
        for least in (1, int(np.sort(score)[-20]), int(score.max()) + 1):
            got = bucket.survivors(own, weights[own], counts, least)
            assert set(np.flatnonzero(score >= least)) <= set(got) and (bucket.exact(got, weighted) == score[got]).all()
        assert len(bucket.survivors(own, weights[own], counts, int(np.sort(score)[-20]))) < n / 2
        assert len(bucket.survivors(own, weights[own], counts, int(1e15))) == 0


def test_term_text():
    text = pa.array(["A-Z[é]` {~}\x7f\x80İ 09/:", None, ""])
    assert ranked.term_text(text).to_pylist()[0].split(" ") == "a z é       \x80İ 09  ".split(" ")
