"""Near-duplicate documents by a chosen-path similarity join on their word shingles.

A tree of nodes is never built: the path of a document down a tree follows from its minhash values and from hashes of
the nodes, so a row (node, document) for three levels at once is made without any exchange. A node picks one position
of the minhash signature, in a quarter of cases two, which keeps a pair at the threshold alive on 1.0 branches per
level on average while each dissimilar pair dies out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.batches import batch_words, mix, shingle_hashes, sliced, word_hashes
from tidemark.llm.common import checked_broadcast, modest_batches, read, spread_join, stored
from tidemark.llm.components import connected

POSITIONS = 128
TREES = 12
LEVELS = 3
SMALL = 256
SMALL_MIXED = 2048
SLACK = 0.18
TREE_BITS, SLOTS = 15, 4
SLICE = 2 << 20  # bytes of text whose words are held at once


def doc_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; of fewer words, the whole sequence as one."""
    offsets, codes, distinct = batch_words(texts, lower=True)
    hashes = word_hashes(distinct)[codes]
    out = []
    for i in range(len(offsets) - 1):
        own = hashes[offsets[i]:offsets[i + 1]]
        k = min(n, len(own))
        out.append(np.unique(shingle_hashes(own, k)) if k == n else mix(shingle_hashes(own, k) + np.uint64(k)) if k else np.zeros(0, np.uint64))
    return out


def _set_id(x: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) if len(x) else None


def _signature(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """Low bytes of the minhash values at all positions."""
    low = (x >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        best = np.minimum(best, ((low[i:i + 2048, None] ^ b) * a).min(axis=0))
    return (best * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def _describe(n: int):
    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20)
        a, b = (rng.integers(0, 2**32, POSITIONS, dtype=np.uint32) for _ in range(2))
        a |= np.uint32(1)
        for batch in batches:
            sets = doc_sets(batch.column("text"), n)
            sids = [_set_id(s) for s in sets]
            marks = [_signature(s, a, b) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.int64()),
                                              pa.array(marks, pa.binary())], ["doc_id", "n_shingles", "sid", "sketch"])
    return describe


def _sets(n: int):
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = doc_sets(batch.column("text"), n)
            out = pa.RecordBatch.from_arrays([batch.column("sid"), pa.array([s.tobytes() for s in got], pa.binary())], ["sid", "shingles"])
            yield out.filter(pc.equal(out.column("sid"), pa.array([_set_id(s) for s in got], pa.int64())))  # not another text of that doc_id
    return sets


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), POSITIONS)


def _down(sketch: np.ndarray, rows: np.ndarray, keys: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and node keys so many levels further down."""
    for _ in range(levels):
        h = mix(keys + np.uint64(1))
        first = (h % np.uint64(POSITIONS)).astype(np.int64)
        again = (h >> np.uint64(40)) % np.uint64(4) == 0
        second = (first + 1 + ((h >> np.uint64(20)) % np.uint64(POSITIONS - 1)).astype(np.int64)) % POSITIONS
        r, p, k = (np.concatenate([x, y[again]]) for x, y in ((rows, rows), (first, second), (keys, keys)))
        with np.errstate(over="ignore"):
            keys = mix(mix(k) + p.astype(np.uint64) * np.uint64(256) + sketch[r, p].astype(np.uint64))
        rows = r
    return rows, keys


def _from_roots(sketch: np.ndarray, trees: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and node keys so many levels below the roots; the low bits of a key name its tree."""
    n, rows, keys = len(sketch), [], []
    for tree in range(trees):
        r, k = _down(sketch, np.arange(n), np.full(n, mix(np.uint64(tree + 1))), levels)
        rows.append(r)
        keys.append(k & ~np.uint64(TREE_BITS) | np.uint64(tree))
    return np.concatenate(rows), np.concatenate(keys)


def _listed(sketch: np.ndarray, trees: int, levels: int) -> np.ndarray:
    """Up to ``SLOTS`` node keys of each document in each tree; a list that is longer is cut, which only repeats some comparisons."""
    rows, keys = _from_roots(sketch, trees, levels)
    tree = (keys & np.uint64(TREE_BITS)).astype(np.int64)
    order = np.lexsort((tree, rows))
    group = rows[order] * trees + tree[order]
    place = np.arange(len(group)) - np.searchsorted(group, group)
    out = np.arange(len(sketch) * trees * SLOTS, dtype=np.uint64).reshape(len(sketch), trees, SLOTS)  # free slots differ everywhere
    some = place < SLOTS
    out[group[some] // trees, group[some] % trees, place[some]] = keys[order][some]
    return out


def _paths(trees: int, levels: int, deeper: bool):
    """(key, sid) of the nodes that each document reaches, from the roots of all trees or from its nodes so far."""
    def paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch, n = _bytes(batch.column("sketch")), batch.num_rows
            if deeper:
                rows, keys = _down(sketch, np.arange(n), np.asarray(batch.column("key")).view(np.uint64), levels)
            else:
                rows, keys = _from_roots(sketch, trees, levels)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("sid").take(pa.array(rows))], ["key", "sid"])
    return paths


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=EDGE)


def _whole_nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by node, cut so that no node is split; what a batch leaves open is carried over."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0] if batch.num_rows else rest
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column("key"))
        start = int(np.flatnonzero(key == key[-1])[0])
        rest = batch.slice(start)
        if start:
            yield batch.slice(0, start)
    if rest is not None:
        yield rest


def _steps(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """All pairs (i, i + d) within nodes, as distance and positions, a few thousand at a time."""
    at = np.arange(len(key))
    for d in range(1, len(key)):
        at = at[:np.searchsorted(at, len(key) - d)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            return
        for part in np.array_split(at, max(1, len(at) // 4096)):
            yield d, part


def _closest(least: int):
    """First look at small nodes: each document with its most alike predecessor. A row of a document with itself marks one that is like any other."""
    def closest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_nodes(batches):
            sid, key, sketch = np.asarray(batch.column("sid")), np.asarray(batch.column("key")), _bytes(batch.column("sketch"))
            best, partner, like = np.zeros(len(sid), np.int64), np.zeros(len(sid), np.int64), np.zeros(len(sid), bool)
            for d, at in _steps(key):
                same = (sketch[at] == sketch[at + d]).sum(axis=1)
                more = same > best[at + d]
                best[at[more] + d], partner[at[more] + d] = same[more], sid[at[more]]
                like[at[same >= least]] = True
            hit = best >= least
            yield pa.RecordBatch.from_arrays([pa.array(np.append(sid[hit], sid[like])), pa.array(np.append(partner[hit], sid[like])),
                                              pa.array(np.append(best[hit], np.zeros(like.sum(), np.int64)))], ["sid", "partner", "same"])
    return closest


def _across(batch: pa.RecordBatch, least: int, trees: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of alike documents of different components; of the nodes that hold both (below the roots) only the first compares them."""
    key, sketch, label = np.asarray(batch.column("key")), _bytes(batch.column("sketch")), np.asarray(batch.column("label"))
    listed = _listed(sketch, trees, LEVELS) if trees else None
    own = key.view(np.uint64)
    for d, at in _steps(key):
        at = at[label[at] != label[at + d]]
        at = at[(sketch[at] == sketch[at + d]).sum(axis=1) >= least]
        if trees and len(at):
            common = (listed[at][:, :, :, None] == listed[at + d][:, :, None, :])
            tree = (own[at] & np.uint64(TREE_BITS)).astype(np.int64)
            before = common.any(axis=(2, 3)) & (np.arange(trees) < tree[:, None])
            same = np.where(common.any(axis=3), listed[at], np.uint64(2**64 - 1))[np.arange(len(at)), tree].min(axis=1)
            at = at[~before.any(axis=1) & (same >= own[at])]
        if len(at):
            yield at, at + d


def _involved(least: int, trees: int):
    """Documents of small nodes that have an alike one in another component of the node."""
    def involved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_nodes(batches):
            some = np.zeros(batch.num_rows, bool)
            for i, j in _across(batch, least, trees):
                some[i] = some[j] = True
            yield batch.select(["key", "sid", "label", "sketch"]).filter(pa.array(some))
    return involved


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _joining(least: int, trees: int, percent: int):
    """Confirmed links between components of a node, on full sets; components that are joined already are not compared again."""
    def joining(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_nodes(batches):
            sid, label, key = (np.asarray(batch.column(c)) for c in ("sid", "label", "key"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("shingles")]
            top: dict = {}

            def root(x):
                while top.get(x, x) != x:
                    x = top[x]
                return x
            found = []
            for left, right in _across(batch, least, trees):
                for i, j in zip(left.tolist(), right.tolist(), strict=True):
                    a, b = root((key[i], label[i])), root((key[j], label[j]))
                    if a != b and _alike(sets[i], sets[j], percent):
                        top[a] = b
                        found.append((sid[i], sid[j]))
            if found:
                yield _edges(*np.array(found, np.int64).T)
    return joining


def _star(least: int):
    def star(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hit = (_bytes(batch.column("sketch")) == _bytes(batch.column("pivot_sketch"))).sum(axis=1) >= least
                yield _edges(np.asarray(batch.column("sid"))[hit], np.asarray(batch.column("pivot"))[hit])
    return star


def _confirm(percent: int):
    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(*(np.frombuffer(z.as_buffer(), np.uint64) for z in pair), percent) for pair in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return confirm


def link(docs: DataFrame, n: int = 2, percent: int = 80, trees: int = TREES, small: int = SMALL) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept (it is its own component_id).

    Documents are linked where the Jaccard similarity of their sets of lower-cased ``n``-word shingles is at least
    ``percent`` in a hundred, confirmed on the full sets. Equal sets are one vertex. Nodes of up to ``small`` documents
    are compared exhaustively by signature, each document is then confirmed against its most alike; of larger ones every
    document meets the node's pivot. Nodes that still hold several components, up to ``SMALL_MIXED`` documents, get the
    full sets of the documents that are alike across components, and compare those; larger ones go further down the
    tree. No group is ever paired within itself, and rounds go on until no large node holds two components. With 12 trees a lone pair at exactly 80 % is missed about once in 10^5.

    Joins are between written tables, which lets Spark split a partition that holds a hot key and send small tables whole.

    Null or blank texts have an empty set and are linked with nothing. Rows without doc_id are linked with nothing and
    kept. Repeated rows share their component. Other columns are not read; an empty table gives no rows.
    """
    own = modest_batches(docs).select("doc_id", "text")
    least = int((percent / 100 - SLACK) * POSITIONS)
    described = stored(own.mapInArrow(sliced(_describe(n), most=SLICE), "doc_id long, n_shingles long, sid long, sketch binary"), "near-described")
    real = described.filter("sid IS NOT NULL AND doc_id IS NOT NULL")
    unique = stored(real.groupBy("sid").agg(F.min("doc_id").alias("first_doc"), F.first("sketch").alias("sketch")), "near-unique")
    recs = stored(unique.select("sid", "sketch").mapInArrow(_paths(trees, LEVELS, False), "key long, sid long"), "near-paths")
    nodes = _nodes(recs, unique)
    links = roots = sets = None
    deep = False
    while True:
        inside = nodes if roots is None else _mixed(nodes, roots)
        limit = small if roots is None else SMALL_MIXED
        few = inside.filter(F.col("m") <= limit).drop("pivot", "m").repartition("key").sortWithinPartitions("key", "sid")
        many = inside.filter(F.col("m") > limit)
        pivots = unique.select(F.col("sid").alias("pivot"), F.col("sketch").alias("pivot_sketch"))
        star = spread_join(many.select("sid", "sketch", "pivot"), pivots, "pivot", F.col("sid")).mapInArrow(_star(least), "a long, b long")
        if roots is None:
            met = few.mapInArrow(_closest(least), "sid long, partner long, same long")  # over all nodes, one most alike for each document
            best = stored(met.groupBy("sid").agg(F.max_by("partner", F.col("same") * (1 << 40) + F.pmod("partner", F.lit(1 << 40))).alias("partner")), "near-closest")
            marked = best.select("sid").union(best.select("partner")).union(many.select("sid")).distinct()
            sets = stored(_full_sets(own, unique, marked, n), "near-sets")
            found = best.filter("sid <> partner").select(F.least("sid", "partner").alias("a"), F.greatest("sid", "partner").alias("b"))
            links = stored(_verify(found.unionByName(star.filter("a < b")).distinct(), sets, percent), "near-links")
        else:
            once = 0 if deep or not many.isEmpty() else trees  # a pair may be left to an earlier node only if that is a small one
            mixed = few.mapInArrow(_involved(least, once), "key long, sid long, label long, sketch binary")
            held = mixed.join(sets, "sid").repartition("key").sortWithinPartitions("key", "sid")
            joining = held.mapInArrow(_joining(least, once, percent), "a long, b long")
            star = _verify(star.filter("a < b").distinct(), sets, percent)
            links = links.unionByName(stored(joining.unionByName(star).distinct(), "near-links"))
        more, first = many.select("key", "sid", "sketch"), roots is None
        roots = connected(links)
        if more.isEmpty() and (not first or inside.isEmpty()):
            break
        if not first:
            recs, deep = stored(more.mapInArrow(_paths(trees, LEVELS, True), "key long, sid long"), "near-paths"), True
            nodes = _nodes(recs, unique)
    comp = unique.select("sid", "first_doc").join(roots.select(F.col("id").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least_doc = comp.groupBy("root").agg(F.min("first_doc").alias("component"))
    comp = stored(comp.select("sid", "root").join(least_doc, "root").select("sid", "component"), "near-component-of")
    out = described.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("sid")).alias("sid")).join(comp, "sid", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"))


def _nodes(recs: DataFrame, unique: DataFrame) -> DataFrame:
    """Documents in nodes of two or more: key, sid, m (size), pivot, sketch."""
    node = recs.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min_by("sid", F.xxhash64("sid", "key")).alias("pivot")).filter("m > 1")
    inside = recs.join(stored(node, "near-sizes"), "key")
    return stored(inside.join(unique.select("sid", "sketch"), "sid").select("key", "sid", "m", "pivot", "sketch"), "near-nodes")


def _mixed(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that hold several components, with the component of each document as label."""
    own = nodes.join(roots.select(F.col("id").alias("sid"), "root"), "sid", "left").withColumn("label", F.coalesce("root", "sid")).drop("root")
    split = own.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    return stored(own.join(split, "key", "left_semi"), "near-mixed")


def _full_sets(own: DataFrame, unique: DataFrame, marked: DataFrame, n: int) -> DataFrame:
    """Full sets (sid, shingles) of the marked documents; their texts are read once more."""
    wanted = stored(unique.join(marked, "sid", "left_semi").select("sid", F.col("first_doc").alias("doc_id")), "near-wanted")
    return own.join(checked_broadcast(wanted), "doc_id").select("sid", "text").mapInArrow(sliced(_sets(n), most=SLICE), "sid long, shingles binary").dropDuplicates(["sid"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike."""
    left = pairs.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = left.join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("set_b")), "b")
    return both.mapInArrow(_confirm(percent), "a long, b long")


def keep_first(docs: DataFrame, n: int = 2) -> DataFrame:
    """One document of each group of near duplicates by ``n``-word shingles, that with the smallest doc_id; all columns as they were.

    Of rows that repeat a doc_id one stays, the first by hash of its text. Rows without doc_id all stay.
    """
    dropped = stored(link(docs, n).filter("NOT kept").select("doc_id").distinct(), "near-dropped")
    again = stored(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "near-repeated")
    left = docs.join(dropped, "doc_id", "left_anti").select(F.struct(*docs.columns).alias("doc"), "doc_id", "text")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    one = left.join(again, "doc_id", "left_semi").withColumn("rank", rank).filter("rank = 1")
    return left.join(again, "doc_id", "left_anti").select("doc.*").unionByName(one.select("doc.*"))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of near duplicates over all documents: doc_id, n_shingles, component_id, kept."""
    return link(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] WHEN len(w) = 1 THEN w ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, w.doc_id = min(r.c) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY w.doc_id, n.n"""
