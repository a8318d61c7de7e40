"""Packing documents into sequences: a configuration linear program over the length histogram.

The program covers each length's pieces with patterns (multisets of lengths that fit one sequence), as few sequences as
it can. Multiplicative weights solve it: lengths that are covered less weigh more, and a knapsack dynamic program, bounded by the pieces
that are left, finds the heaviest pattern. It is rounded as it goes, and what fills no sequence at the end is packed best-fit.
Only the histogram, which has at most one entry per length, reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import batch_words, sliced
from tidemark.llm.common import modest_batches, read, running, stored

CAPACITY = 4096
END_ID = 1
PLAIN = r"[a-zß-öø-ÿ]+"
TRAILING = ".,!*$%#&|;:?"
KNOWN_WORDS = 150_000
AT_ONCE = 128  # texts whose encodings are held together
SPARE = 0.0005  # share of a sequence that a pattern of the program may leave free; the rest is packed best-fit
PRICED = 64  # lengths that a step prices
PULL = 0.25  # how far the weight of a length that is covered falls


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_in_parts(tokenizer, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text. The tokenizer's notes on a text take far more than its ids, so those of a few texts are held at once."""
    return [np.asarray(e.ids, np.uint32) for i in range(0, len(texts), AT_ONCE) for e in tokenizer.encode_batch_fast(texts[i:i + AT_ONCE], add_special_tokens=False)]


class _Runs:
    """Ids of runs of letters or punctuation, each one pre-token, as a growing ragged array; one for each worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full, self.light = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.light.normalizer = normalizers.Lowercase()
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(
            add_prefix_space=False, trim_offsets=True, use_regex=False)])
        self.last = np.zeros(self.full.get_vocab_size(), bool)
        self.last[[i for t, i in self.full.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self):
        self.words, self.known, self.flat, self.ends = {}, {"": 0}, [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        self.done = 1

    def encode(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all known runs one after the other, and where each run ends; new ones are encoded, many in one text."""
        if len(self.known) > self.done:
            new = list(self.known)[self.done:]
            ids = np.concatenate(encode_in_parts(self.light, [" ".join(new[i:i + 64]) for i in range(0, len(new), 64)]))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(new):
                raise ValueError("a run of letters or punctuation was not one pre-token")
            self.ends.append(ends + self.ends[-1][-1])
            self.flat.append(ids)
            self.flat, self.ends, self.done = [np.concatenate(self.flat)], [np.concatenate(self.ends)], len(self.known)
        return self.flat[0], self.ends[0]


def _runs(path: str) -> _Runs:
    import os
    import sys
    import types

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = sys.modules.setdefault("tidemark_tokenizers", types.ModuleType("tidemark_tokenizers"))
    if path not in kept.__dict__:
        kept.__dict__[path] = _Runs(path)
    return kept.__dict__[path]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each piece, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def encode_words(distinct: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids of all words one after the other, and start and number of each word's; equal to what the tokenizer gives inside a text.

    No rule of the tokenizer looks across white space. A run of plain letters is one pre-token, and so is a run of
    punctuation after it; each ends in a token with an end mark, so many runs are encoded as one text, and a worker
    keeps up to those of ``KNOWN_WORDS`` words. Words of any other form, those that hold an added token of the
    tokenizer among them, go through it one by one.
    """
    import re

    runs, plain = _runs(path), re.compile(PLAIN)
    if len(runs.words) > KNOWN_WORDS:
        runs.clear()
    known, words = runs.known, runs.words
    for w in [w for w in distinct if w not in words]:
        s = w.decode()
        core = s.rstrip(TRAILING)
        low = core.lower()
        if plain.fullmatch(low) and len(low) == len(core):
            words[w] = known.setdefault(low, len(known)) << 32 | known.setdefault(s[len(core):], len(known))
        else:
            words[w] = -1
    both = np.fromiter(map(words.__getitem__, distinct), np.int64, len(distinct))
    odd = np.flatnonzero(both < 0)
    both[odd] = 0
    flat, ends = runs.encode()
    starts = np.concatenate([[0], ends[:-1]])
    n = len(distinct)
    units = np.empty(2 * n, np.int64)
    units[0::2], units[1::2] = both >> 32, both & 0xFFFFFFFF
    sizes = (ends - starts)[units]
    ids = flat[ragged(starts[units], sizes)]
    sizes = sizes.reshape(n, 2).sum(axis=1)
    begin = np.cumsum(sizes) - sizes
    if len(odd):
        rest = encode_in_parts(runs.full, [distinct[i].decode() for i in odd])
        sizes[odd] = [len(x) for x in rest]
        begin[odd] = len(ids) + np.cumsum(sizes[odd]) - sizes[odd]
        ids = np.concatenate([ids, *rest])
    return ids, begin, sizes


def encode_texts(texts: pa.Array, path: str, end: int = END_ID) -> list[np.ndarray]:
    """Ids of each text with the end id; words are encoded once per batch."""
    offsets, codes, distinct = batch_words(texts, lower=False)
    ids, begin, sizes = encode_words(distinct, path)
    out = []
    for i in range(len(offsets) - 1):
        c = codes[offsets[i]:offsets[i + 1]]
        out.append(np.append(ids[ragged(begin[c], sizes[c])], np.uint32(end)))
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int):
    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_texts(batch.column("text"), path), strict=True):
                ids = ids.astype("<u4")
                rows += [(doc_id, k, at, len(ids[at:at + capacity]), zlib.crc32(ids[at:at + capacity].tobytes()))
                         for k, at in enumerate(range(0, len(ids), capacity))]
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])
    return pieces


def heaviest(lengths: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each length, at most ``most``, in the pattern of greatest worth that fits: bounded knapsack by capacity.

    Copies are split into items of 1, 2, 4, ... and a rest; an item is one vectorised step over all capacities.
    """
    items = []
    for i, n in enumerate(np.minimum(most, capacity // lengths).tolist()):
        k = 1
        while n > 0:
            items.append((i, min(k, n)))
            n, k = n - k, 2 * k
    best, took = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for row, (i, k) in zip(took, items, strict=True):
        size = int(lengths[i]) * k
        more = best[:capacity + 1 - size] + worth[i] * k
        np.greater(more, best[size:], out=row[size:])
        np.maximum(more, best[size:], out=best[size:])
    out, c = np.zeros(len(lengths), np.int64), capacity
    for row, (i, k) in zip(took[::-1], items[::-1], strict=True):
        if row[c]:
            out[i] += k
            c -= int(lengths[i]) * k
    return out


def program(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Patterns (index, copies, times) that cover ``counts``, no piece twice, each pattern full but for ``SPARE`` of a sequence.

    A length's dual weight starts as the length and falls exponentially with the share of its pieces that is covered. Each step prices ``PRICED``
    lengths, drawn by the weight of what is left of them, and uses the pattern whole times, until its scarcest length is
    used up. Where the weights lead to a pattern that is not full, the lengths alone are the worth; where that gives none either, twice as many lengths
    are priced. It ends when all is covered or no full pattern of the lengths left is found among all of them.
    """
    rng, left, covered, found, failed = np.random.default_rng(7), counts.copy(), np.zeros(len(lengths)), [], 0
    while left.any():
        open_ = np.flatnonzero(left)
        priced = PRICED << failed
        if priced >= 8 * len(open_):
            break
        if len(open_) > priced:
            key = np.log(lengths[open_] * left[open_]) - covered[open_] + rng.gumbel(size=len(open_))
            open_ = open_[np.argpartition(-key, priced)[:priced]]
        for weight in (1 - PULL + PULL * np.exp(-covered[open_]), np.ones(len(open_))):
            copies = heaviest(lengths[open_], lengths[open_] * weight, left[open_], capacity)
            full = int((lengths[open_] * copies).sum()) >= (1 - SPARE) * capacity
            if full:
                break
        if not full:
            failed += 1
            continue
        failed, idx = 0, open_[copies > 0]
        copies = copies[copies > 0]
        times = int((left[idx] // copies).min())
        left[idx] -= copies * times
        covered[idx] += copies * times / counts[idx]
        found.append((idx, copies, times))
    return found


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns and how many sequences use each: every piece exactly once. A pattern is [(length, copies), ...].

    Depends on the histogram alone. Full-length pieces stand alone. Best-fit takes what the program leaves, which fills no sequence: the
    largest length left, then ever the largest that still fits, the pattern repeated while its lengths last, so that
    it too needs no more patterns than there are lengths.
    """
    order = np.argsort(lengths)
    lengths, left = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order].copy()
    out: dict[tuple, int] = {}

    def take(idx, copies, times):
        left[idx] -= copies * times
        key = tuple((int(lengths[i]), int(c)) for i, c in zip(idx, copies, strict=True))
        out[key] = out.get(key, 0) + times

    full = np.flatnonzero((lengths == capacity) & (left > 0))
    if len(full):
        take(full, np.ones(1, np.int64), int(left[full[0]]))
    for idx, copies, times in program(lengths, left.copy(), capacity):
        take(idx, copies, times)
    while left.any():
        room, idx, copies = capacity, [], []
        while True:
            some = np.flatnonzero((left > 0) & (lengths <= room))
            some = some[~np.isin(some, idx)]
            if not len(some):
                break
            i = int(some[-1])
            c = min(int(left[i]), room // int(lengths[i]))
            idx.append(i)
            copies.append(c)
            room -= c * int(lengths[i])
        idx, copies = np.asarray(idx), np.asarray(copies)
        take(idx, copies, int((left[idx] // copies).min()))
    return [(list(k), n) for k, n in out.items()]


def slots(packed: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Places by length and rank: rows (length, first rank, copies per sequence, first sequence, offset), sorted."""
    rows, used, sequence = [], {}, 0
    for pattern, times in packed:
        offset = 0
        for length, copies in pattern:
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * copies
        sequence += times
    return np.asarray(sorted(rows), np.int64).reshape(-1, 5)


def _place(table: np.ndarray):
    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            row = table[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
            k = rank - row[:, 1]
            arrays = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(row[:, 3] + k // row[:, 2]), pa.array(row[:, 4] + k % row[:, 2] * length)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return place


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its words and the end id; null text is empty and gives the end id alone. Only
    documents over ``capacity`` ids are cut, into pieces of ``capacity`` and a last one. Sequences have no gaps. Pieces
    of a length are numbered by two-level running sums over salts, so that a length that many pieces share is no single
    task; the plan that meets them has at most a few thousand patterns, whatever the number of documents. Repeated rows
    are packed as separate documents, documents without id too. An empty table gives no rows. Other columns are not read.
    """
    cut = stored(modest_batches(docs).select("doc_id", "text").mapInArrow(sliced(_pieces(path or tokenizer_path(), capacity)), PIECES), "pieces")
    histogram = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most one row per length
    table = slots(plan(histogram["length"].to_numpy(), histogram["n"].to_numpy(), capacity))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1024)))
    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = running(salted, ["length"], "salt", order, F.lit(1), "rank")
    schema = f"{PIECES}, sequence_id long, offset long"
    return ranked.mapInArrow(_place(table), schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack(read(spark, sf_dir, "documents"))
