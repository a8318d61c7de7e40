"""Near duplicates, repeated passages and fingerprints against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from helpers import empty, table
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, near_dedup, passages
from tidemark.llm.components import connected


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(data, n=2):
    sets = {i: shingles(t, n) for i, t in data if i is not None}
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def families(seed, groups=14, chain=True):
    """Copies with edits, chains of small steps, singles and exact copies."""
    rnd = random.Random(seed)
    out, k = [], 0
    for g in range(groups):
        base = [rnd.choice("abcdefghij") + str(rnd.randrange(400)) for _ in range(rnd.choice([3, 12, 60, 150]))]
        for c in range(rnd.randrange(1, 9)):
            w = list(base)
            for _ in range(rnd.randrange(0, max(2, len(w) // 9))):
                w[rnd.randrange(len(w))] = "x" + str(rnd.randrange(1000))
            if chain and g % 3 == 0:
                base = w
            out.append((k, " ".join(w).upper() if c % 4 == 3 else " ".join(w)))
            k += 1
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed,small,mixed", [(1, 256, 2048), (2, 3, 8)])
def test_components(spark, monkeypatch, seed, small, mixed):
    """Once with the usual node sizes, once so small that pivots and deeper levels are used."""
    monkeypatch.setattr(near_dedup, "SMALL_MIXED", mixed)
    data = [*families(seed), (900, None), (901, " "), (902, "a"), (903, "A"), (None, "a"), (3, "twice a row"), (3, "twice a row")]
    data = [d for d in data if d[0] != 3 or d[1] == "twice a row"]
    df = spark.createDataFrame(data, "doc_id BIGINT, text STRING")
    got = near_dedup.link(df, small=small).collect()
    want = brute_components(data)
    assert len(got) == len(data)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_large_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = [str(rnd.randrange(10**6)) for _ in range(120)]
    data = []
    for i in range(700):
        w = list(base)
        for _ in range(rnd.randrange(1, 9)):
            w[rnd.randrange(120)] = f"y{rnd.randrange(10**6)}"
        data.append((i, " ".join(w)))
    got = near_dedup.link(spark.createDataFrame(data, "doc_id BIGINT, text STRING")).collect()
    want = brute_components(data)
    assert all(r.component_id == want[r.doc_id][1] for r in got)


def test_keep_first(spark):
    df = table(spark)
    out = near_dedup.keep_first(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(7) == 1 and 64 not in ids and 5 in ids and ids.count(None) == 1 and {60, 61, 62} <= set(ids)
    assert near_dedup.keep_first(empty(spark)).count() == 0 and near_dedup.link(empty(spark)).count() == 0


def test_pipeline_stage_takes_five_words(spark):
    import corpus_pipeline

    data = families(5)
    base = numbered(7, 200)
    data += [(500, " ".join(base)), (501, " ".join(f"q{i}" if i % 20 == 10 else w for i, w in enumerate(base)))]  # 0.82 of two-word, 0.6 of five-word shingles
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = {r.doc_id for r in stage(spark, spark.createDataFrame(data, "doc_id BIGINT, text STRING"), "").collect()}
    assert got == {i for i, (_, c) in brute_components(data, 5).items() if c == i} and {500, 501} <= got
    assert brute_components(data)[501][1] == 500


def test_connected(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.id: r.root for r in connected(spark.createDataFrame(path, "a BIGINT, b BIGINT")).collect()}
    assert len({got[i] for i in range(100, 161)}) == 1 and len({got[i] for i in range(1, 40)}) == 1 and len(set(got.values())) == 3


def test_compact_windows_against_scan():
    rng = np.random.default_rng(0)
    for n, t in ((200, 7), (60, 60), (500, 46), (10, 20), (1, 1)):
        v = rng.integers(1, 80, n).astype(np.uint64)
        want = set()
        for i in range(n):
            a = b = i
            while a > 0 and v[a - 1] > v[i]:
                a -= 1
            while b < n - 1 and v[b + 1] >= v[i]:
                b += 1
            if b - a + 1 >= t:
                want.add((i, a, b))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(v, t)), strict=True)) == want


def test_passages(spark):
    rnd = random.Random(4)

    def prose(n):
        return [f"{rnd.choice('abcdefgh')}{rnd.randrange(5000)}" for _ in range(n)]
    shared, short, near = prose(50), prose(49), prose(200)
    edited = [("zz" if i % 67 == 30 else w) for i, w in enumerate(near)]
    docs = [(i, prose(80) + shared + prose(rnd.randrange(90))) for i in range(40)]
    docs += [(100, prose(60) + near + prose(10)), (101, prose(5) + edited), (102, prose(70) + short), (103, short + prose(70)), (104, prose(300)),
             (105, shared + prose(30) + shared), (106, (p := prose(60)) + prose(9) + p)]
    data = [(i, " ".join(w).title()) for i, w in docs] + [(200, None), (201, ""), (None, " ".join(shared)), (104, docs[44][1] and " ".join(docs[44][1]).title())]
    got = passages.repeats(spark.createDataFrame(data, "doc_id BIGINT, text STRING")).collect()
    assert {r.doc_id for r in got} | {r.other_id for r in got} == {*range(40), 100, 101, 105}
    place = dict(docs)
    for r in got:
        if r.doc_id < 40:
            at = next(k for k in range(200) if place[r.doc_id][k:k + 50] == shared)
            assert r.other_id == 0 and r.start <= at and r.stop >= at + 50 and r.stop - r.start <= 60
    one = next(r for r in got if r.doc_id == 101)
    assert one.other_id == 100 and one.stop - one.start >= 120 and one.similarity >= 0.8
    assert passages.repeats(empty(spark)).count() == 0


def numbered(seed, n):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(10**8)}" for _ in range(n)]


@pytest.mark.parametrize("gap", [0, 3])
def test_adjacent_passages_that_stand_apart_elsewhere(spark, gap):
    one, two = numbered(1, 50), numbered(2, 50)
    docs = [(1, two + numbered(3, 400) + one), (2, numbered(4, 30) + one + numbered(5, gap) + two + numbered(6, 30))]
    got = passages.repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id BIGINT, text STRING")).collect()
    assert sorted((r.start, r.stop, r.other_start, r.other_stop) for r in got) == [(30, 80, 450, 500), (80 + gap, 130 + gap, 0, 50)]


def test_every_place_of_a_repeat(spark):
    one = numbered(1, 60)
    twice, once = numbered(2, 40) + one + numbered(3, 500) + one + numbered(4, 40), numbered(5, 70) + one + numbered(6, 20)
    for docs, column in (([(1, once), (2, twice)], "start"), ([(1, twice), (2, once)], "other_start")):
        got = passages.repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id BIGINT, text STRING")).collect()
        assert {r[column] for r in got} == {40, 600} and all(r.doc_id == 2 and r.other_id == 1 for r in got)


def test_exact_repeats_behind_a_variant_of_smaller_id(spark):
    docs = []
    for g in range(40):
        one = numbered(g, 60)
        docs += [(g, numbered(1000 + g, 30) + [f"z{g}" if i % 13 == 6 else w for i, w in enumerate(one)]),
                 (100 + g, numbered(2000 + g, 30) + one), (200 + g, one + numbered(3000 + g, 30))]
    got = passages.repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id BIGINT, text STRING")).collect()
    assert {(r.other_id, r.doc_id) for r in got} == {(100 + g, 200 + g) for g in range(40)}


def test_passages_among_documents_with_one_common_phrase(spark):
    phrase, passage = numbered(1, 25), numbered(2, 30) + numbered(1, 25) + numbered(3, 30)
    docs = [(i, numbered(100 + i, 60) + phrase + numbered(300 + i, 60)) for i in range(90)]
    docs += [(i, numbered(100 + i, 40) + passage + numbered(300 + i, 40)) for i in (45, 77, 95)]
    docs = list(dict(docs).items())
    got = passages.repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id BIGINT, text STRING")).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(77, 45), (95, 45)} and all(r.start <= 40 and r.stop >= 125 for r in got)


def likeness(x, y):
    x, y = shingles_case(x), shingles_case(y)
    return len(x & y) / len(x | y) if x | y else 1.0


def shingles_case(text):
    w = text.encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("rows", [7, 1024])
def test_fingerprints(spark, rows):
    df = table(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    paired = fingerprints.with_next(df, lambda d: d.withColumn("n", d["doc_id"] * 2), ["n"], rows)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    got = paired.collect()
    assert len(got) == len(ids) and all(r.next_text == texts[after[r.doc_id]] and r.next_n == 2 * after[r.doc_id] for r in got)


def test_fingerprint_values(spark):
    df = table(spark)
    got = fingerprints.fingerprints(df).collect()
    assert len(got) == df.count() and fingerprints.fingerprints(empty(spark)).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == by[64].fingerprint and by[60].fingerprint == by[61].fingerprint == by[62].fingerprint == ""
    assert by[61].near_next == 1.0 and by[60].n_chars == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    after, error = dict(zip(ids, ids[1:] + ids[:1], strict=True)), []
    for r in fingerprints.fingerprints(docs).collect():
        t, nxt = texts[r.doc_id], texts[after[r.doc_id]]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        error += [r.near_edited - likeness(t, edited), r.near_next - likeness(t, nxt)]
    assert abs(np.mean(error)) < 0.01 and np.sqrt(np.mean(np.square(error))) < 0.05


@pytest.mark.parametrize("words,edits", [(60, 1), (80, 1), (120, 2)])
def test_recall_of_near_passages(spark, words, edits):
    """Passages whose shingle sets are 0.83 to 0.88 alike, edits anywhere, in documents that share nothing else."""
    rnd = random.Random(words)
    docs, n = [], 70
    for i in range(n):
        passage = numbered(f"p{words}-{i}", words)
        near = list(passage)
        for k in range(edits):
            near[rnd.randrange(k * words // edits, (k + 1) * words // edits)] = f"edit{i}-{k}"
        docs += [(2 * i, numbered(f"a{i}", rnd.randrange(5, 90)) + passage + numbered(f"b{i}", rnd.randrange(5, 90))),
                 (2 * i + 1, numbered(f"c{i}", rnd.randrange(5, 90)) + near + numbered(f"d{i}", rnd.randrange(5, 90)))]
    got = passages.repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id BIGINT, text STRING")).collect()
    pairs = {(r.doc_id, r.other_id) for r in got}
    assert all(a == b + 1 and b % 2 == 0 for a, b in pairs) and len(pairs) >= 0.9 * n, len(pairs) / n


def test_longest_stretch_that_does_not_fall():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60):
        for _ in range(100):
            total = np.append(0.0, np.cumsum(np.where(rng.random(n) < 0.85, 1 / 9, -8 / 9)))
            a, b = passages.best_stretch(total, n + 1)
            want = max(j - i for i in range(n + 1) for j in range(i, n + 1) if total[j] >= total[i] - 1e-9)
            assert b - a == want and total[b] >= total[a] - 1e-9


def test_agreements_in_small_parts(spark, monkeypatch):
    docs = [(i, " ".join((numbered(f"x{i}", 40) + numbered("line", 12) * 9 + numbered(f"y{i}", 30)))) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    whole = sorted(passages.repeats(df).collect())
    monkeypatch.setattr(passages, "PAIRS", 3)
    assert sorted(passages.repeats(df).collect()) == whole and len(whole) >= 5


@pytest.mark.parametrize("ids", [[-(2**62) - 5, 2**62 + 5, 0], [*range(300), 2**62], [*range(-500, -200), *(2**k for k in range(62)), 2**63 - 1, -(2**63)], [5], [7, 7, 7, 8]])
def test_fingerprints_of_distant_and_repeated_ids(spark, ids):
    data = [(i, f"text {n} of {i}") for n, i in enumerate(ids)] + [(None, "no id b"), (None, "no id a"), (None, None)]
    df = spark.createDataFrame(data, "doc_id BIGINT, text STRING")
    own = df.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("chunk", fingerprints.chunks(df, 16))
    rows = sorted(own.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h))
    assert [r.chunk for r in rows] == sorted(r.chunk for r in rows)  # ranges follow the order
    sizes = own.filter("doc_id IS NOT NULL").groupBy("chunk").count().collect()
    assert len(ids) < 100 or max(r["count"] for r in sizes) <= 64
    got = fingerprints.with_next(df, lambda d: d.withColumn("n", F.col("h")), ["n"], 16).collect()
    after = {(r.doc_id, r.text or ""): rows[(k + 1) % len(rows)].text or "" for k, r in enumerate(rows)}
    assert len(got) == len(data) and all(r.next_text == after[r.doc_id, r.text] for r in got)


def test_one_id_on_very_many_rows_is_cut_by_its_texts(spark):
    df = spark.createDataFrame([(3, f"text {i}") for i in range(400)] + [(i, "x") for i in range(40)], "doc_id BIGINT, text STRING")
    own = df.withColumn("h", F.xxhash64("text")).withColumn("chunk", fingerprints.chunks(df, 20))
    assert max(r["count"] for r in own.groupBy("chunk").count().collect()) <= 60
    assert fingerprints.fingerprints(df).count() == 440


def in_batches(rows, names, rnd):
    import pyarrow as pa

    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
    cuts = sorted({0, len(rows), *(rnd.randrange(len(rows)) for _ in range(len(rows) // 4))})
    return [pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in columns], names) for a, b in itertools.pairwise(cuts)]


def rows_of(batches):
    return sorted(tuple(r.values()) for b in batches for r in b.to_pylist())


@pytest.mark.parametrize("seed", range(12))
def test_minhashes_of_several_documents_pass_through(seed):
    rnd = random.Random(seed)
    rows = sorted((rnd.randrange(-9, 9), rnd.randrange(1 + seed * seed), k, k) for k in range(rnd.choice([1, 7, 80])))
    want = [r for r in rows if len({d for v, d, *_ in rows if v == r[0]}) > 1]
    assert rows_of(passages._shared(in_batches(rows, ["v", "doc_id", "place", "c"], rnd))) == sorted(want)


@pytest.mark.parametrize("most", [2, 500_000])
@pytest.mark.parametrize("seed", range(8))
def test_first_meetings_in_small_batches(monkeypatch, seed, most):
    monkeypatch.setattr(passages, "MEETINGS", most)
    rnd = random.Random(seed)
    rows, n = [], rnd.choice([1, 9, 120])
    for _ in range(n):
        l, size = rnd.randrange(300), rnd.randrange(60)
        rows.append((rnd.randrange(-5, 5), rnd.randrange(2 + seed * 2), l, l + size, l + 3, l + 9))
    rows.sort()
    packed = [(q, d, l << 32 | r, a << 32 | b) for q, d, l, r, a, b in rows]
    got = [r for b in passages._first_meetings(in_batches(packed, ["q", "doc_id", "wide", "core"], rnd)) for r in b.to_pylist()]
    more, pairs = [], []
    for q in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == q]
        rep = min(r[1] for r in own)
        least, most_r = min(r[2] for r in own if r[1] == rep), max(r[3] for r in own if r[1] == rep)
        pairs += [(d, rep, l, r, least, most_r) for _, d, l, r, _, _ in own if d > rep]
        if len({r[1] for r in own}) > 2:
            more += [(q, d, rep, l, r, a, b) for _, d, l, r, a, b in own if d > rep]
    assert sorted(tuple(r.values()) for r in got if r["q"] is not None) == sorted(more)
    found = [np.array(x, np.int64) for x in zip(*[tuple(r.values())[1:] for r in got if r["q"] is None], strict=True)]
    want = islands(pairs)
    assert islands([tuple(map(int, r)) for r in zip(*found, strict=True)]) == want
    if pairs and most > 2:
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == want  # one task joins all it sees


def islands(pairs):
    out = []
    for d, rep, l, r, a, b in sorted(pairs):
        if out and out[-1][:2] == (d, rep) and l <= out[-1][3]:
            out[-1] = (d, rep, out[-1][2], max(r, out[-1][3]), min(a, out[-1][4]), max(b, out[-1][5]))
        else:
            out.append((d, rep, l, r, a, b))
    return out


def test_no_pair_that_is_alike_is_left_out_before():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2**32, 160, np.uint32)
    texts = []
    for n in range(200):
        x = np.concatenate([rng.integers(0, 2**32, rng.integers(0, 40), np.uint32), y[rng.integers(0, 60):rng.integers(50, 160)]])
        x[rng.random(len(x)) < rng.choice([0, 0.1, 0.15, 0.5])] = 7
        texts.append(x[:rng.integers(0, 200)])
    some = passages.promising(np.isin(np.concatenate(texts), y), np.array([len(x) for x in texts]), 30, 80)
    found = np.array([bool(passages.alike(x, y, 30, 80)) for x in texts])
    assert found.any() and not (found & ~some).any() and not some.all()


def test_texts_of_a_family_are_moved_once_for_a_tile_of_pairs(spark, monkeypatch):
    """Variants under 80 % alike meet each other in many pairs; each text goes to few tiles."""
    rnd, base = random.Random(9), numbered(1, 300)
    docs = [(i, " ".join(w if rnd.random() > 0.05 else f"v{i}-{k}" for k, w in enumerate(base))) for i in range(40)]
    kept = {}
    write = passages.released

    def released(df, purpose):
        out = write(df, purpose)
        kept.setdefault(purpose, []).append(out)
        return out
    monkeypatch.setattr(passages, "released", released)
    passages.repeats(spark.createDataFrame(docs, "doc_id BIGINT, text STRING")).collect()
    pairs = moved = 0
    for tiles in kept["passage-tiles"]:
        rows = tiles.collect()
        pairs += len(rows)
        moved += len({(r.tile, i) for r in rows for i in (r.doc_id, r.rep)})
    assert pairs > 200 and moved < pairs / 2
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def placed(words, k, at=()):
    """``words`` with others at the places ``at``, among words of its own."""
    return numbered(f"before{k}", 30) + [f"edit{k}-{i}" if i in at else w for i, w in enumerate(words)] + numbered(f"after{k}", 30)


def pairs_of(spark, docs):
    got = passages.repeats(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id BIGINT, text STRING")).collect()
    return {(r.doc_id, r.other_id) for r in got}


def test_a_document_with_a_row_still_meets_those_without(spark):
    """Of three, the last is like the two others, which are not alike: both links have a row."""
    docs = []
    for g in range(60):
        one = numbered(f"chain{g}", 54)
        docs += [(g, placed(one, f"a{g}", (8,))), (100 + g, placed(one, f"b{g}", (44,))), (200 + g, placed(one, f"c{g}"))]
    got = pairs_of(spark, docs)
    assert all(a % 100 == b % 100 and a >= 200 for a, b in got)  # 0.65 alike at most without the third
    linked = {b for _, b in got}
    # each pair meets under two of four functions in 97 cases of 100, and a row of one pair costs the other nothing
    assert len(linked & set(range(60))) >= 56 and len(linked & set(range(100, 160))) >= 56


def test_a_row_between_two_classes_stays(spark):
    kind = "doc_id long, start long, stop long, other_id long, other_start long, other_stop long, similarity double"
    rows = [(a, 0, 60, b, 0, 60, 0.9) for a, b in [(4, 1), (3, 2), (4, 3), (12, 10), (13, 10), (13, 12), (23, 20), (24, 20), (24, 21), (23, 21), (24, 23)]]
    got = {(r.doc_id, r.other_id) for r in passages._once(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(4, 1), (3, 2), (4, 3), (12, 10), (13, 10), (23, 20), (24, 20), (24, 21), (23, 21)}


def test_classes_are_those_of_all_pairs(spark):
    """Variants of one text: rows join whatever the pairs alone join."""
    rnd, base = random.Random(11), numbered("family", 70)
    docs = [(i, placed(base, i, {rnd.randrange(70) for _ in range(rnd.randrange(4))})) for i in range(24)]
    alone = set()
    for a, b in itertools.combinations(docs, 2):
        x, y = (np.array([hash(tuple(w[k:k + 5])) & 0xFFFFFFFF for k in range(len(w) - 4)], np.uint32) for w in (a[1], b[1]))
        if passages.alike(y, x, 46, 80):
            alone.add((b[0], a[0]))
    got = pairs_of(spark, docs)
    assert got <= alone and 10 < len(alone) < 200

    def classes(pairs):
        root = {i: i for i, _ in docs}
        for a, b in sorted(pairs) * len(docs):
            root[a] = root[b] = min(root[a], root[b])
        return root
    assert classes(got) == classes(alone)


def test_borders_of_ranges_are_literals(spark):
    """They are not read from text again for each row: that took as long as rows times ranges."""
    df = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text", "id AS h")
    plan = df.select(fingerprints.chunks(df, 10).alias("chunk"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("filter(") <= 2 * plan.count("transform(") <= 8
