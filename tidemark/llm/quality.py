"""Quality rules: base counts of every text and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tidemark.llm.batches import batch_words, shingle_hashes, sliced, word_hashes
from tidemark.llm.common import read

WORD_BUCKETS, CHAR_BUCKETS = 8192, 4096
SIZE = WORD_BUCKETS + CHAR_BUCKETS
SAMPLE = 3000
THRESHOLD = 0.35  # least calibrated probability of good quality
SYMBOLS = b"#*$%&|<>"

_CLASS = np.zeros(256, np.int64)
_CLASS[[32, *range(9, 14)]] = 1
_CLASS[128:192] = 2
_CLASS[list(SYMBOLS)] = 3


def features(hashes: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed words and word pairs, and of hashed runs of one to three bytes."""
    out = np.zeros(SIZE)
    if len(hashes):
        words = np.concatenate([hashes, shingle_hashes(hashes, 2)]) % np.uint64(WORD_BUCKETS)
        out[:WORD_BUCKETS] = np.bincount(words.astype(np.int64), minlength=WORD_BUCKETS) / len(words)
    if len(raw):
        code, grams = np.zeros(len(raw), np.uint32), []
        for n in range(1, min(3, len(raw)) + 1):
            code = (code[:len(raw) - n + 1] << np.uint32(8)) + raw[n - 1:]
            grams.append((code + np.uint32(n << 24)) * np.uint32(2654435761) >> np.uint32(20))
        grams = np.concatenate(grams)
        out[WORD_BUCKETS:] = np.bincount(grams, minlength=CHAR_BUCKETS) / len(grams)
    return np.sqrt(out)


def repeated_words(codes: np.ndarray, kinds: int) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(codes) < 4:
        return 0
    pair = codes[:-1] * kinds + codes[1:]
    if kinds >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * kinds + codes[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    mark = np.zeros(len(codes), bool)
    for i in range(3):
        mark[i:len(key) + i] |= twice
    return int(mark.sum())


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).cast(pa.large_binary()).fill_null(b"").to_pylist()


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse feature vectors of labelled texts."""
    for batch in batches:
        offsets, codes, distinct = batch_words(batch.column("text"), lower=False)
        hashes = word_hashes(distinct)[codes]
        rows = [features(hashes[offsets[i]:offsets[i + 1]], np.frombuffer(t, np.uint8)) for i, t in enumerate(_texts(batch, "text"))]
        at = [np.flatnonzero(r) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array([a.astype(np.int32).tobytes() for a in at], pa.binary()),
                                          pa.array([r[a].astype(np.float32).tobytes() for r, a in zip(rows, at, strict=True)], pa.binary())],
                                         ["quality", "at", "value"])


class Model:
    """Weights, bias and calibration; without both labels in the sample every text is good."""

    def __init__(self, labels: np.ndarray, at: list[np.ndarray], value: list[np.ndarray], steps: int = 80, rate: float = 0.3, decay: float = 1e-4):
        self.weights, self.slope, self.shift = np.zeros(SIZE), 0.0, 20.0
        if not len(labels) or labels.min() == labels.max():
            return
        fit = np.arange(len(labels)) % 5 != 0  # a fifth is kept for the calibration
        y = labels.astype(float)
        row, col, val = np.repeat(np.arange(len(y), dtype=np.int32), [len(a) for a in at]), np.concatenate(at), np.concatenate(value)
        inside = fit[row]
        r, c, x = row[inside], col[inside], val[inside]
        weigh = np.where(y > 0, 0.5 / max(y[fit].sum(), 1), 0.5 / max((1 - y[fit]).sum(), 1)) * fit
        w, bias, m, v = np.zeros(SIZE), 0.0, np.zeros(SIZE + 1), np.zeros(SIZE + 1)
        for t in range(1, steps + 1):
            z = np.bincount(r, x * w[c], len(y)) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weigh
            grad = np.append(np.bincount(c, x * g[r], SIZE) + decay * w, g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w, bias = w - step[:-1], bias - step[-1]
        self.weights = w
        z, y = (np.bincount(row, val * w[col], len(y)) + bias)[~fit], y[~fit]
        y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of a two-parameter logistic fit
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            r, s = p - y, np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(s * z * z).sum() + 1e-6, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
            da, db = np.linalg.solve(h, [(r * z).sum(), r.sum()])
            a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        self.slope, self.shift = a, a * bias + b

    def probability(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights) + self.shift, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A classifier fitted on a bounded sample of labelled documents.

    Labels whose hash of doc_id falls under the share that gives about ``sample`` rows are taken (all, where there are
    fewer), which bounds what is broadcast and what the driver gets. Null labels and documents without id are left out.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    share = min(1.0, sample / max(known.count(), 1))
    some = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) <= int(share * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "quality")
    got = rows.drop("doc_id").mapInArrow(sliced(_features), "quality int, at binary, value binary").collect()
    got = sorted(got, key=lambda r: (r["at"], r["value"], r["quality"]))
    return Model(np.array([r["quality"] for r in got], int), [np.frombuffer(r["at"], np.int32) for r in got],
                 [np.frombuffer(r["value"], np.float32) for r in got])


RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean"


def _score(model: Model, threshold: float):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RULES.split(", ")]
        for batch in batches:
            offsets, codes, distinct = batch_words(batch.column("text"), lower=False)
            hashes = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
            rows = []
            for i, text in enumerate(_texts(batch, "text")):
                raw = np.frombuffer(text, np.uint8)
                own = codes[offsets[i]:offsets[i + 1]]
                kinds = np.bincount(_CLASS[raw], minlength=4)
                lines = [x for x in text.split(b"\n") if x.strip()]
                n, repeats = len(own), repeated_words(own, len(distinct))
                failed = n < 50 or 100 * repeats > 50 * n
                p = model.probability(features(hashes[offsets[i]:offsets[i + 1]], raw))
                rows.append((n, len(raw) - kinds[1] - kinds[2], kinds[3], len(lines) - len(set(lines)), repeats, failed, p, not failed and p >= threshold))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc", *names])
    return score


def rate(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_score, kept) for every document.

    ``doc`` is the struct of all columns. A text fails the base rules with under 50 words, or with over half of its
    words in repeated three-word windows; others are kept where the calibrated probability of good quality reaches the
    threshold. Null texts have no words and fail. Each row is judged on its own, repeated rows alike. Very long texts
    are read whole. Extra columns stay inside ``doc``. An empty table gives no rows.
    """
    packed = docs.select(F.struct("*").alias("doc"), F.col("text"))
    schema = StructType([StructField("doc", packed.schema["doc"].dataType), *_parse_datatype_string(RULES).fields])
    return packed.mapInArrow(sliced(_score(model, threshold)), schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from ``labels``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rated = rate(docs, learn(docs, read(spark, sf_dir, "labels")))
    return rated.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_score")
