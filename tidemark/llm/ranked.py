"""Ranked lexical search: exact top lists of integer impact scores by norm buckets.

Every document is a sparse vector of impacts over the terms that the items ask for. Vectors are ordered by length and cut
into buckets. The product of an item's and a bucket's length (Cauchy-Schwarz) tells whether any vector of the bucket can reach the
item's list; inside a bucket, the largest coordinate of each term bounds what the terms not looked at can add, and so does the
length that is left of item and vector. What survives is scored again exactly in integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.batches import batch_words, rows_of, sliced
from tidemark.llm.common import read, stored

K = 20
BUCKET = 4096  # vectors of about equal length that are bounded together
HEAD = 32  # one in so many documents, the longest vectors, are searched first for the least scores worth looking for
PAIRS = 1_000_000  # (item, term) pairs that are searched for at once; more items make more blocks
SLACK = 1 + 1e-9
# Code points between terms, and the constants of the impact.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
SCALE, TF, LENGTH, BASE, SHARE = 1_000_000_000, 1000, 12, 100, 25

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[SEPARATORS] = 32
_BYTES[65:91] += 32


def term_text(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lowered and everything between terms turned to blanks."""
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()) if texts.offset else texts.cast(pa.large_string())
    valid, offsets, data = texts.buffers()
    data = pa.py_buffer(_BYTES[np.frombuffer(data, np.uint8)]) if data is not None else None
    return pa.Array.from_buffers(pa.large_string(), len(texts), [valid, offsets, data])


def _item_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_id, term, c): how often an item asks for a term."""
    for batch in batches:
        offsets, codes, distinct = batch_words(term_text(batch.column("text")), lower=False)
        if not len(codes):
            continue
        pair, c = np.unique(rows_of(offsets) * len(distinct) + codes, return_counts=True)
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(pair // len(distinct))),
                                          pa.array(distinct, pa.binary()).take(pa.array(pair % len(distinct))), pa.array(c)], ["item_id", "term", "c"])


VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"


def _vectors(vocabulary: pa.Array):
    """Number of terms of each document that has any, and the counts of those of ``vocabulary``."""
    size = len(vocabulary)

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, codes, distinct = batch_words(term_text(batch.column("text")), lower=False)
            some = np.flatnonzero(np.diff(offsets))
            if not len(some):
                continue
            own = pc.index_in(pa.array(distinct, pa.binary()), value_set=vocabulary).fill_null(size).to_numpy(zero_copy_only=False)[codes]
            pair, tf = np.unique((rows_of(offsets) * size + own)[own < size], return_counts=True)
            at = np.searchsorted(pair, np.append(some, some[-1] + 1) * size).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(some)), pa.array(np.diff(offsets)[some]),
                pa.ListArray.from_arrays(pa.array(at), pa.array((pair % max(size, 1)).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(at), pa.array(tf.astype(np.int32)))], [x.split()[0] for x in VECTORS.split(", ")])
    return vectors


def _csr(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and values."""
    offsets = np.asarray(column.offsets, np.int64)
    return offsets - offsets[0], np.asarray(column.flatten())


def _impacts(weights: np.ndarray, docs: int, terms: int):
    """Impacts instead of counts, and the length of the vector under the terms' weights."""
    def impacts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, which = _csr(batch.column("terms"))
            tf = _csr(batch.column("tfs"))[1].astype(np.int64)
            m = (BASE - SHARE) + (SHARE * np.asarray(batch.column("n"), np.int64) * docs) // terms
            imp = (SCALE * tf) // (TF * tf + LENGTH * np.repeat(m, np.diff(at)))
            norm = np.bincount(rows_of(at), weights=weights[which] * imp.astype(float) ** 2, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.sqrt(norm)), batch.column("terms"),
                                              pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(imp.astype(np.int32)))], ["doc_id", "norm", "terms", "imps"])
    return impacts


class Bucket:
    """Vectors by row and by term, with the bounds of a bucket."""

    def __init__(self, at: np.ndarray, terms: np.ndarray, imps: np.ndarray, norms: np.ndarray, size: int):
        self.at, self.terms, self.imps, self.n = at, terms, imps, len(norms)
        self.longest, self.square = float(norms.max(initial=0.0)), norms * norms
        order = np.argsort(terms, kind="stable")
        self.row, self.by_term = rows_of(at)[order], imps[order]
        self.column = np.searchsorted(terms[order], np.arange(size + 1))
        self.top = np.zeros(size, np.int64)
        held = np.flatnonzero(np.diff(self.column))
        if len(held):
            self.top[held] = np.maximum.reduceat(self.by_term, self.column[held])

    def survivors(self, terms: np.ndarray, weights: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
        """Rows whose score can be ``least`` (at least 1) or more for the item with these terms, weights and counts."""
        none = np.zeros(0, np.int64)
        if math.sqrt(float((counts * counts * weights).sum())) * self.longest * SLACK + 1 < least:
            return none
        bound = counts * weights * self.top[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        rest = np.append(bound[order][::-1].cumsum()[::-1], 0)  # what the terms from here on can add at most
        if rest[0] < least:
            return none
        focus = int(np.flatnonzero(rest < least)[0])  # a vector without any of these terms stays below
        score, square = np.zeros(self.n, np.int64), np.zeros(self.n)
        for i in order[:focus]:
            a, b = self.column[terms[i]], self.column[terms[i] + 1]
            imp = self.by_term[a:b]
            score[self.row[a:b]] += counts[i] * weights[i] * imp
            square[self.row[a:b]] += weights[i] * imp.astype(float) ** 2
        found = np.flatnonzero(score > 0)
        left = order[focus:]
        length = math.sqrt(float((counts[left] ** 2 * weights[left]).sum()))
        more = np.minimum(float(rest[focus]), length * np.sqrt(np.maximum(self.square[found] * SLACK - square[found], 0)) * SLACK + 1)
        return found[score[found] + more >= least]

    def exact(self, rows: np.ndarray, weighted: np.ndarray) -> np.ndarray:
        """Scores of the rows, whole vectors against an item given as weight by term."""
        sizes = self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(sizes)
        inner = np.repeat(self.at[rows] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        total = np.append(0, np.cumsum(weighted[self.terms[inner]] * self.imps[inner]))
        return total[ends] - total[ends - sizes]


FOUND = "item int, doc_id long, score long"


def _search(items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, k: int, least: np.ndarray):
    """The ``k`` best documents of the partition for each item, of those that score at least ``least``."""
    size = len(weights)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.maximum(least, 1)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in items]
        for batch in batches:
            lengths = np.asarray(batch.column("norm"))
            by_length = np.argsort(-lengths, kind="stable")
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for a in range(0, len(by_length), BUCKET):
                some = by_length[a:a + BUCKET]
                part = batch.take(pa.array(some))
                at, terms = _csr(part.column("terms"))
                bucket = Bucket(at, terms, _csr(part.column("imps"))[1].astype(np.int64), lengths[some], size)
                for q, (own, counts) in enumerate(items):
                    rows = bucket.survivors(own, weights[own], counts, int(floor[q]))
                    if not len(rows):
                        continue
                    weighted = np.zeros(size, np.int64)
                    weighted[own] = counts * weights[own]
                    score = bucket.exact(rows, weighted)
                    enough = score >= floor[q]
                    had = best[q]
                    score = np.append(had[0], score[enough])
                    doc, no_id = np.append(had[1], ids[some[rows[enough]]]), np.append(had[2], null[some[rows[enough]]])
                    top = np.lexsort((doc, no_id, -score))[:k]
                    best[q] = score[top], doc[top], no_id[top]
                    if len(top) == k:
                        floor[q] = max(floor[q], score[top[-1]])  # equal scores may still come first by id
        sizes = [len(b[0]) for b in best]
        if sum(sizes):
            score, doc, no_id = (np.concatenate(x) for x in zip(*best, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(items), dtype=np.int32), sizes)), pa.array(doc, mask=no_id), pa.array(score)],
                                             ["item", "doc_id", "score"])
    return search


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, asked: list, k: int) -> DataFrame:
    """Rows (item_id, rank, doc_id, score) for the items of ``asked``, rows (item_id, term, c)."""
    spark = docs.sparkSession
    names = sorted({r["item_id"] for r in asked}, key=lambda i: (i is None, i or 0))
    vocabulary = sorted({bytes(r["term"]) for r in asked})
    number, term = {x: i for i, x in enumerate(names)}, {t: i for i, t in enumerate(vocabulary)}
    raw = stored(docs.select("doc_id", "text").mapInArrow(sliced(_vectors(pa.array(vocabulary, pa.binary()))), VECTORS), "ranked-counts")
    n, length = raw.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in raw.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        df[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    items: list[tuple[list, list]] = [([], []) for _ in names]
    for r in asked:
        t = term[bytes(r["term"])]
        if df[t] and weights[t] > 0:
            items[number[r["item_id"]]][0].append(t)
            items[number[r["item_id"]]][1].append(r["c"])
    items = [(np.array(t, np.int64), np.array(c, np.int64)) for t, c in items]
    vectors = raw.mapInArrow(_impacts(weights, n, length), "doc_id long, norm double, terms array<int>, imps array<int>")
    order = [F.col("norm").desc(), F.xxhash64("doc_id")]
    vectors = stored(vectors.filter("norm > 0").repartitionByRange(*order).sortWithinPartitions(*order), "ranked-vectors")
    border = vectors.approxQuantile("norm", [1 - 1 / HEAD], 0.25 / HEAD)
    border = border[0] if border else 0.0
    spread = max(2, spark.sparkContext.defaultParallelism)
    search = _search(items, weights, k, np.zeros(len(items), np.int64))
    head = stored(_ranked(vectors.filter(F.col("norm") >= border).repartition(spread, F.xxhash64("doc_id")).mapInArrow(search, FOUND), k), "ranked-head")
    least = np.zeros(len(items), np.int64)
    for r in head.filter(F.col("rank") == k).select("item", "score").toLocalIterator():
        least[r["item"]] = r["score"]
    rest = vectors.filter(F.col("norm") < border).mapInArrow(_search(items, weights, k, least), FOUND)
    ids = F.broadcast(spark.createDataFrame(list(enumerate(names)), "item int, item_id long"))  # one row for each item of the block
    return _ranked(head.drop("rank").unionByName(rest), k).join(ids, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of all other code points from U+0080 on, A-Z lowered. Texts are read once for
    each block of items; a block has about ``PAIRS`` (item, term) pairs, so what is sent to the tasks is bounded. Longest vectors are searched
    first; each task then looks only for documents that score at least as much as the ``k``-th of those and of its own.

    A null or empty text has no terms and is in no list and no count; an item without terms has no rows. Documents of equal score
    go by ascending doc_id, those without id last; rows repeated are documents of their own. Rows of equal item_id are one
    item. Columns beside doc_id and text, and item_id and text, are not read. Empty tables give no rows.
    """
    asked = stored(items.select("item_id", "text").mapInArrow(sliced(_item_terms), "item_id long, term binary, c long")
                   .groupBy("item_id", "term").agg(F.sum("c").alias("c")), "ranked-items")
    blocks = -(-asked.count() // PAIRS)
    out = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about PAIRS rows
        if own:
            rows = _block(docs, own, k)
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else _nothing(docs.sparkSession)


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of all for each benchmark item."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
SQL = f"""
WITH held AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY doc_id, term),
sizes AS (SELECT doc_id, sum(tf) AS n FROM held GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n) AS terms FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM held, whole GROUP BY term, docs),
asked AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20
"""
