"""Language of every text: script ranges narrow the candidates of a word, a Viterbi path over words labels spans."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from tidemark.llm.batches import batch_words, mix, sliced
from tidemark.llm.common import modest_batches, read

BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
SWITCH = 12.0
SAMPLE = 20_000
# First code points of the ranges that scripts are told apart by.
RANGES = ((0x00, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"),
          (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
          (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"))
SCRIPTS = sorted({s for _, s in RANGES})
_STARTS = [a for a, _ in RANGES]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def word_scripts(distinct: list[bytes]) -> np.ndarray:
    """Index into SCRIPTS of each word's first letter, -1 without a letter."""
    latin = SCRIPTS.index("latin")
    out = np.full(len(distinct), -1)
    for i, w in enumerate(distinct):
        if w.isalpha():
            out[i] = latin
        else:
            for c in w.decode():
                if c.isalpha():
                    out[i] = SCRIPTS.index(RANGES[bisect_right(_STARTS, ord(c)) - 1][1])
                    break
    return out


def word_grams(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of each word with a mark at both ends, one after the other, and the word of each."""
    flat = np.frombuffer(b" " + b" ".join(distinct) + b" ", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    word = np.append(np.repeat(np.arange(len(distinct), dtype=np.int32), sizes + 1), np.int32(-1))  # the blank in front counts as the word's
    grams, owner, code = [], [], np.zeros(len(flat), np.uint64)
    edge = flat == 32
    for n in range(1, max(GRAMS) + 1):
        m = len(flat) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(256) + flat[n - 1:n - 1 + m]
        if n in GRAMS:
            inner = np.zeros(m, bool)
            for i in range(1, n - 1):
                inner |= edge[i:i + m]
            ok = ~inner & (~edge[:m] if n == 1 else ~(edge[:m] & edge[n - 1:n - 1 + m]))
            at = np.flatnonzero(ok)
            grams.append((mix(code[at] + np.uint64(n << 40)) % np.uint64(BUCKETS)).astype(np.int32))
            owner.append(word[at])
    return np.concatenate(grams), np.concatenate(owner)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams and of scripts, a row for each language of the partition."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        offsets, codes, distinct = batch_words(batch.column("text"), lower=True)
        if not distinct:
            continue
        grams, owner = word_grams(distinct)
        scripts = word_scripts(distinct)
        doc = np.repeat(np.arange(len(langs)), np.diff(offsets))
        for lang in set(langs):
            mine = np.asarray([x == lang for x in langs])[doc]
            times = np.bincount(codes[mine], minlength=len(distinct)).astype(float)
            own = np.concatenate([np.bincount(grams, weights=times[owner], minlength=BUCKETS),
                                  np.bincount(scripts + 1, weights=times, minlength=len(SCRIPTS) + 1)])
            total[lang] = total.get(lang, 0) + own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["lang", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), float) for x in table.column("counts"))
    return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


class Model:
    """Log-probabilities of n-gram buckets and allowed scripts for each language."""

    def __init__(self, langs: list[str], counts: list[np.ndarray]):
        self.langs = langs
        grams = np.array([c[:BUCKETS] for c in counts]).reshape(len(langs), BUCKETS)
        scripts = np.array([c[BUCKETS + 1:] for c in counts]).reshape(len(langs), len(SCRIPTS))
        self.logs = (np.log(grams + 0.5) - np.log(grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32).copy()
        self.allowed = (scripts >= 0.01 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T
        self.allowed[~self.allowed.any(axis=1)] = True

    def word_scores(self, distinct: list[bytes], scripts: np.ndarray) -> np.ndarray:
        """Score of each word under each language, best 0; words without letters tell nothing."""
        grams, owner = word_grams(distinct)
        out = np.stack([np.bincount(owner, weights=self.logs[grams, k], minlength=len(distinct)) for k in range(len(self.langs))], axis=1)
        some = scripts >= 0
        out[some] = np.where(self.allowed[scripts[some]], out[some], out[some].min(axis=1, keepdims=True) - SWITCH)
        out[~some] = 0
        return (out - out.max(axis=1, keepdims=True)).astype(np.float32)


def viterbi(scores: np.ndarray, codes: np.ndarray, offsets: np.ndarray, switch: float) -> np.ndarray:
    """Label of every word: the path of most score through each text, a change of label costing ``switch``; all texts step together."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begin, longest = offsets[:-1][order], int(sizes.max(initial=0))
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    labels = scores.shape[1]
    jump = np.full(len(codes), -1, np.int8)  # label that a switch into this word comes from
    kept = np.zeros((len(codes), labels), bool)
    value = np.zeros((len(order), labels), np.float32)
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        v = value[:n]
        best = v.argmax(axis=1)
        top = v[np.arange(n), best][:, None] - np.float32(switch)
        stay = v >= top
        jump[at], kept[at] = best, stay
        value[:n] = np.where(stay, v, top) + scores[codes[at]]
    label = value.argmax(axis=1)
    out = np.zeros(len(codes), np.int64)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        now = label[:n]
        out[at] = now
        label[:n] = np.where(kept[at, now], now, jump[at])
    return out


SPANS = "array<struct<lang:string,start:int,stop:int>>"
SLICE = 1 << 20  # bytes of text whose words and n-grams are held at once


def _predict(model: Model, switch: float, with_spans: bool):
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, langs = batch.num_rows, model.langs
            offsets, codes, distinct = batch_words(batch.column("text"), lower=True)
            pred, score, starts, firsts = ["und"] * n, np.zeros(n), np.zeros(0, np.int64), np.zeros(n + 1, np.int32)
            label, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if distinct and langs:
                scripts = word_scripts(distinct)
                label = viterbi(model.word_scores(distinct, scripts), codes, offsets, switch)
                letters = scripts[codes] >= 0
                doc = np.repeat(np.arange(n), np.diff(offsets))
                votes = np.bincount((doc * len(langs) + label)[letters], minlength=n * len(langs)).reshape(n, len(langs))
                total, best = votes.sum(axis=1), votes.argmax(axis=1)
                score = np.where(total > 0, votes.max(axis=1) / np.maximum(total, 1), 0.0)
                pred = [langs[b] if t else "und" for b, t in zip(best, total, strict=True)]
            arrays = [batch.column("doc"), batch.column("text"), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if with_spans:
                if len(label):
                    starts = np.flatnonzero(np.append(True, (np.diff(label) != 0) | (np.diff(doc) != 0)))
                    firsts = np.searchsorted(doc[starts], np.arange(n + 1)).astype(np.int32)
                base = offsets[doc[starts]]
                own = pa.StructArray.from_arrays([pa.array(langs, pa.string()).take(pa.array(label[starts])), pa.array((starts - base).astype(np.int32)),
                                                  pa.array((np.append(starts[1:], len(label))[:len(starts)] - base).astype(np.int32))], fields=list(kind.value_type))
                arrays.append(pa.ListArray.from_arrays(pa.array(firsts), own).cast(kind))
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "text", "lang_pred", "score", "lang_spans"][:len(arrays)])
    return predict


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled documents that are not held out.

    A classifier, so it is fitted on a bounded sample: documents whose hash of doc_id falls under the share that gives about ``sample``
    rows (all, where there are fewer). Counts are summed by language in Spark; the driver gets one row of
    32,779 sums for each language. Null languages, null texts and documents without id are not learned from.
    """
    known = modest_batches(docs).select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = known.count()
    share = min(1.0, sample / max(rows, 1))
    some = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else known
    counts = some.select("text", "lang").repartition(32).mapInArrow(sliced(_count, most=SLICE), "lang string, counts binary")
    got = sorted((r["lang"], r["counts"]) for r in counts.groupBy("lang").applyInArrow(_add, "lang string, counts binary").collect())
    return Model([g[0] for g in got], [np.frombuffer(g[1], float) for g in got])


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """Rows (doc, text, lang_pred, score, lang_spans): ``doc`` is the struct of all columns of a document but its text.

    Words are lower-cased runs of non-blank bytes, scored by their byte n-grams under each language whose scripts they
    may be in. ``lang_pred`` is the language of most words with letters, ``score`` its share of them, ``lang_spans`` the
    spans of words (stop exclusive) by language, left out unless ``spans``. Null, blank and letterless texts, and all texts where nothing was
    learned, are ``und`` with score 0. Equal votes go to the language first in code point order. Every row is
    predicted on its own, repeated rows alike; extra columns stay inside ``doc``.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(None).cast("string").alias("none")]
    packed = modest_batches(docs).select(F.struct(*rest).alias("doc"), F.col("text"))
    schema = StructType([StructField("doc", packed.schema["doc"].dataType), *_parse_datatype_string(
        "text string, lang_pred string, score double" + (f", lang_spans {SPANS}" if spans else "")).fields])
    return packed.mapInArrow(sliced(_predict(model, switch, spans), most=SLICE), schema)


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Documents of ``docs`` whose language is told with at least that share of the words; all columns as they were."""
    found = identify(docs, learn(docs), spans=False)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Predicted language of all documents: doc_id, held_out, lang_pred, score."""
    docs = read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs), spans=False)
    return found.select("doc.doc_id", F.coalesce(held_out(F.col("doc.doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
