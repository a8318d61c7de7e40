"""Scoring texts: an add-half unigram base over exact corpus counts, and a gated recurrent language model.

Counts of every word of the training documents are summed in Spark. The most frequent words are known to the network
one by one; every other word is scored by the network as "one of the rest" and then by its share among the rest, from
the same exact counts. Counts of a bounded head of the vocabulary are sent to the tasks, the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.batches import batch_words, sliced
from tidemark.llm.common import read, spread_join, stored

SENT = 1 << 18  # words whose counts are sent to the tasks
STREAMS = 1024
SCORED = 10 << 20  # bytes of codes that are scored together
AT_ONCE = 1 << 22  # codes that are laid out as streams together
PARTS = 64  # pieces that a parameter vector is summed in

CODED = ("rid long, doc_id long, held_out boolean, n_tokens long, codes binary, known long, logs double, rest_logs double, n_rest long, "
         "far array<long>")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 by 5; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's distinct words and how often they occur in it."""
    for batch in batches:
        _, codes, distinct = batch_words(batch.column("text"), lower=True)
        yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.binary()), pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """Words of the training documents and how often they occur: word, h (64-bit hash), c. Summed by batch and by task before the exchange."""
    each = docs.filter(~held_out(F.col("doc_id"))).select("text").mapInArrow(sliced(_counts), "word binary, n long")
    return each.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("c")).withColumn("h", F.xxhash64("word"))


def _code(sent: np.ndarray, counts: np.ndarray, head: int, end: int):
    """Codes of every text for the network, and what the counts that were sent say. ``sent`` are hashes by falling count; the first are the head."""
    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        order = np.argsort(sent)
        ranked = sent[order]
        base, number = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            n = batch.num_rows
            offsets, codes, distinct = batch_words(batch.column("text"), lower=True)
            h = np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in distinct), np.uint64, len(distinct)).view(np.int64)
            at = np.minimum(np.searchsorted(ranked, h), max(len(ranked) - 1, 0))
            hit = ranked[at] == h if len(ranked) else np.zeros(len(h), bool)
            rank = np.where(hit, order[at], -1) if len(ranked) else np.full(len(h), -1)
            c = np.where(hit, counts[rank], 0) if len(ranked) else np.zeros(len(h))
            tail = np.fromiter((w[-1] * 7 + (w[-2] if len(w) > 1 else 0) for w in distinct), np.int64, len(distinct)) % gru.BUCKETS
            symbol = np.where(hit & (rank < head), rank + 1, gru.HEAD + tail)
            logs = np.where(hit, np.log10(c + 0.5), 0.0)
            doc = np.repeat(np.arange(n), np.diff(offsets))
            rest, known = symbol[codes] >= gru.HEAD, hit[codes]
            own = logs[codes]

            def total(weights):
                return np.bincount(doc, weights=weights, minlength=n)
            all_logs = total(own) + np.log10(end + 0.5)
            out = symbol[codes].astype(np.uint16)
            bound = [(int(offsets[i]), int(offsets[i + 1])) for i in range(n)]
            far = h[codes]
            rows = [pa.array(base + number + np.arange(n)), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(offsets) + 1),
                    pa.array([np.append(out[a:b], np.uint16(0)).tobytes() for a, b in bound], pa.binary()),
                    pa.array((total(known) + (end > 0)).astype(np.int64)), pa.array(all_logs), pa.array(total(own * rest)), pa.array(total(rest).astype(np.int64)),
                    pa.array([far[a:b][~known[a:b]] for a, b in bound], pa.list_(pa.int64()))]
            number += n
            yield pa.RecordBatch.from_arrays(rows, [x.split()[0] for x in CODED.split(", ")])
    return code


def _train(params: np.ndarray):
    """Each task learns from all codes of its part of the corpus, ``AT_ONCE`` at a time, and gives its weights times tokens."""
    def train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, tokens, held, size = gru.Trainer(gru.shaped(params)), 0, [], 0

        def learn():
            codes = np.frombuffer(b"".join(held), np.uint16).astype(np.int64)
            trainer.streams(codes, STREAMS)
            return len(codes)
        for batch in batches:
            for codes in batch.column("codes").to_pylist():
                held.append(codes)
                size += len(codes)
                if size >= 2 * AT_ONCE:
                    tokens += learn()
                    held, size = [], 0
        if held:
            tokens += learn()
        if tokens:
            parts = np.array_split(gru.flat(trainer.p).astype(float) * tokens, PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS)), pa.array([x.tobytes() for x in parts], pa.binary()),
                                              pa.array(np.full(PARTS, tokens))], ["part", "weights", "tokens"])
    return train


def _sum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for k, w, n in zip(*[batch.column(c).to_pylist() for c in ("part", "weights", "tokens")], strict=True):
            old = total.get(k)
            x = np.frombuffer(w, float)
            total[k] = [x + old[0], n + old[1]] if old else [x, n]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x, _ in total.values()], pa.binary()),
                                      pa.array([n for _, n in total.values()], pa.int64())], ["part", "weights", "tokens"])


def frequent(counted: DataFrame, most: int) -> list:
    """The most frequent words, at most ``most``, by falling count, of equal counts by the word.

    A histogram tells which classes of counts (a 256th of a doubling wide) fit whole, so that no more words than are sent reach the driver.
    """
    level = F.floor(F.log2(F.col("c")) * 256)
    sizes = sorted(((r["level"], r["n"]) for r in counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # 16,384 at most
    least, total = None, 0
    for at, n in sizes:
        total += n
        if total > most:
            break
        least = at
    got = counted.filter(level >= least).select("word", "h", "c").collect() if least is not None else []
    return sorted(got, key=lambda r: (-r["c"], r["word"]))


def fit(coded: DataFrame, first: np.ndarray) -> np.ndarray:
    """Weights learned from all training documents in two rounds: tasks learn from the same start (the unigram model), their weights are averaged by tokens.

    A round takes one half of the documents, by a hash of the id. The driver gets sums of the weights, at most 32 for each of 64 pieces.
    """
    params = first
    known = coded.filter("NOT held_out").select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), "codes")
    for half in (0, 1):
        kind = "part long, weights binary, tokens long"
        sums = known.filter(F.col("half") == half).select("codes").mapInArrow(_train(params), kind).repartition(32).mapInArrow(_sum, kind).collect()
        parts: dict[int, list] = {}
        for r in sums:
            old = parts.get(r["part"], [0.0, 0])
            parts[r["part"]] = [old[0] + np.frombuffer(r["weights"], float), old[1] + r["tokens"]]
        if parts:
            params = np.concatenate([parts[k][0] / parts[k][1] for k in sorted(parts)]).astype(np.float32)
    return params


def gathered(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their codes have ``most`` bytes or more: texts that step together cost one pass over the longest."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("codes").nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _score(params: np.ndarray):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = gru.shaped(params)
        for batch in gathered(batches, SCORED):
            texts = [np.frombuffer(c.as_buffer(), np.uint16) for c in batch.column("codes")]
            names = [c for c in batch.schema.names if c != "codes"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(gru.score(p, texts))], [*names, "net"])
    return score


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents that are not held out. Tokens are the lower-cased words and one end. ``base_score`` is the
    add-half unigram log10-probability; ``score`` is the network's for the end and the frequent words, and for a word of the
    rest the network's for the rest times (c + 0.5) / (tokens of the rest + 0.5 * (words of the rest + 1)), so that all
    words and one unseen word together have probability 1. State is carried through each whole text.

    A null text is empty and has the end alone. Documents without id are learned from. Repeated rows are scored each;
    ties among frequent words go by the word. Other columns are not read. Without training documents all counts are 0
    and the network stays at its start. An empty table gives no rows.
    """
    own = docs.select("doc_id", "text")
    counted = stored(vocabulary(own), "lm-vocabulary")
    ends = own.filter(~held_out(F.col("doc_id"))).count()
    n_words, kinds = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = frequent(counted, SENT)
    sent, counts = np.array([r["h"] for r in top], np.int64), np.array([r["c"] for r in top], np.int64)
    head = gru.HEAD - 1
    n, v = n_words + ends, kinds + (ends > 0)
    rest_mass = float(n_words - counts[:head].sum()) + 0.5 * (kinds - min(head, len(counts)) + 1)

    known = own.withColumn("held_out", held_out(F.col("doc_id")))
    coded = stored(known.mapInArrow(sliced(_code(sent, counts, head, ends)), CODED), "lm-coded")
    far = coded.select("rid", F.explode("far").alias("h")).groupBy("rid", "h").agg(F.count(F.lit(1)).alias("times"))
    met = spread_join(far, counted.select("h", "c"), "h", F.col("rid"), "left")
    rest = met.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("far_logs"),
                                  F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("far_known"))
    params = fit(coded, gru.flat(gru.start(np.append(ends, counts[:head]), float(n_words - counts[:head].sum()))))
    kind = "rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, rest_logs double, n_rest long, net double"
    scored = coded.drop("far").mapInArrow(_score(params), kind)
    out = scored.join(rest, "rid", "left")
    more = F.coalesce("far_logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
                      F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("logs") + more - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))).alias("base_score"),
                      (F.col("net") + F.col("rest_logs") + more - F.col("n_rest") * F.lit(float(np.log10(rest_mass)))).alias("score"))


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    """All documents scored by a model learned from those that are not held out."""
    return score(read(spark, sf_dir, "documents"))
