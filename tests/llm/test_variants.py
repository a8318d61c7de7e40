import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import empty, rows, table

from tidemark.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(data):
    out = Counter()
    for doc_id, text in data:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(words):
    out = {}
    for a, n in words.items():
        close = [b for b in words if abs(len(a) - len(b)) <= 1 and is_near(a, b)]
        form = min(close, key=lambda b: (-words[b], b), default=None)
        form = form if form is not None and words[form] >= 5 * n else None
        out[a] = [form, a, n, len(close), words[form] if form else None]
    for row in out.values():
        while out[row[1]][0] is not None:
            row[1] = out[row[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def corpus(seed=1):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice(["tion", "ing", "er", "ab", "ou", "é", "ÿ", "À"]) for _ in range(rnd.randrange(2, 6))) for _ in range(60)]
    kinds = [(s, 200) for s in stems] + [(s[:k] + c + s[k + d:], 8) for s in stems for k in range(0, len(s), 2) for c, d in (("", 1), ("x", 0), ("q", 1))]
    kinds += [("a" * 70, 40), ("a" * 69, 6), ("a" * 30 + "b" + "a" * 39, 6), ("z" * 5000, 6), ("z" * 4999, 5), ("pattern", 220), ("pattarn", 36), ("pattar", 6)]
    words = [w for w, n in kinds for _ in range(n)]
    rnd.shuffle(words)
    step = 200
    return [(i, " ".join(w.upper() if i % 5 == 0 and w.isascii() else w for w in words[a:a + step]) + ", 9 ×÷ 你好") for i, a in enumerate(range(0, len(words), step))]


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("longest", [variants.LIST, 3])
def test_groups_equal_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(variants, "RARE", 20)
    data = [*corpus(), (None, "without without without without without identity"), (7, None), (8, "")]
    got = found(variants.group(table(spark, [(i, t, "en", "a", 1, "x", 1, "s") for i, t in data]), longest))
    want = brute(counted(data))
    assert got == want and len(got) > 300 and any(r[0] != r[1] and r[0] for r in got.values())


def test_small_tables(spark):
    assert variants.group(empty(spark)).count() == 0
    data = [(r[0], r[1]) for r in rows()]
    assert found(variants.group(table(spark))) == brute(counted(data))


def test_runs_and_checksums():
    text = pa.array(["Aé9ß×÷ÀZ, İx €ÿ\xa0b", None, "", "ù" * 3])
    assert [x.split() if x else x for x in variants.run_text(text).to_pylist()] == [["aéßxx"[:2], "ß×÷Àz", "x", "ÿ", "b"], None, "", ["ùùù"]]
    heads, tails = [b"12:", b"-3:", b"900000000000:"], [b"a", b"word", "éà".encode(), b"long" * 40]
    both = list(itertools.product(range(3), range(4)))
    got = variants.crc_after(np.array([zlib.crc32(h) for h in heads], np.uint32), np.array([len(t) for t in tails]), np.array([zlib.crc32(t) for t in tails], np.uint32),
                             np.array([t for _, t in both]), np.array([h for h, _ in both]))
    assert got.tolist() == [zlib.crc32(heads[h] + tails[t]) for h, t in both]


def test_an_edit_leaves_a_chosen_gram():
    rnd = random.Random(4)
    words = list({"".join(rnd.choice("abcé") for _ in range(rnd.randrange(6, 12))).encode("latin-1") for _ in range(400)})
    grams, n = np.unique(np.concatenate([(w := variants.Words(words)).grams(q)[w.left >= q] for q in range(2, 6)]), return_counts=True)
    grams, n = grams[n > 30], n[n > 30]
    for word in words[:60]:
        for k in range(len(word) + 1):
            for other in {word[:k] + word[k + 1:], word[:k] + b"b" + word[k:], word[:k] + b"c" + word[k + 1:]} - {word}:
                a, b = ({(g, p) for _, _, p, g in zip(*variants.Words([x]).chosen(grams, n), strict=True)} for x in (word, other))
                assert any(g == h and abs(p - q) <= 1 for g, p in a for h, q in b)


def test_no_pairs_meet_nowhere():
    words = [b"abcdefg", b"abcdefh", b"zzzzzz"]
    chosen = variants._Chosen(words, np.zeros(0, np.int64), np.zeros(0, np.int64))
    none = np.zeros(0, np.int64)
    assert [len(x) for x in chosen.first(none, none, np.zeros(0, bool))] == [0, 0] and variants.near(words, none, none).tolist() == []
    assert variants.near(words, np.array([0, 0]), np.array([1, 2])).tolist() == [True, False]
    assert variants._summed(words, np.ones(3, np.int64), none, none) is None
