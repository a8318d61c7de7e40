"""Spelling variants of words by a variable-length gram index.

The dictionary of grams is pruned by frequency: a gram is made longer, from two letters to five at most, as long as more words hold
it than a threshold. Each place of a word begins one gram of its own, the shortest that is rare enough, so a gram
depends on the letters inside it alone and an edit touches just the grams that stand around it. The most grams of a word that
any single edit can touch is its bound: a near word shares all others, hence one of the word's ``bound + 1`` rarest.
Only those make the lists. In a list, words meet by length and by the place of the gram, are verified, and a pair counts where
its first common gram is.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import GOLD, batch_words, mix, rows_of, slices
from tidemark.llm.common import modest_batches, read, spread_join, stored

LEAST_LENGTH, LEAST_COUNT, RATIO, EDIT = 6, 5, 5, 199
SHORTEST, LONGEST = 2, 5
RARE = 200  # a gram that more words hold is made longer
DICTIONARY = 200_000  # the threshold is raised so that no more grams of a length are over it
LIST = 20_000  # words of a list that are compared directly; longer lists go by deletions
PAIRS = 200_000  # pairs that are compared at once
WIDE = 64
SLICE = 2 << 20

# Letters as bytes: the texts' C3 and the byte after it are U+00C0 to U+00FF, everything else but A-Z and a-z separates.
_BYTES = np.full(256, 32, np.uint8)
_BYTES[97:123] = np.arange(97, 123)
_BYTES[65:91] = np.arange(97, 123)


def run_text(texts: pa.Array) -> pa.Array:
    """The texts with everything between runs of letters turned to blanks, A-Z lowered."""
    texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()) if texts.offset else texts.cast(pa.large_string())
    valid, offsets, data = texts.buffers()
    if data is None:
        return texts
    b = np.frombuffer(data, np.uint8)
    out = _BYTES[b]
    lead = np.flatnonzero(b == 0xC3)
    out[lead] = 0xC3
    out[lead + 1] = b[lead + 1]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [valid, offsets, pa.py_buffer(out)])


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)  # fixed value: the polynomial of crc32
    return c


_CRC = _crc_table()


def crc_after(heads: np.ndarray, sizes: np.ndarray, tails: np.ndarray, which: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """crc32 of head + tail for each (owner, which): heads' checksums by owner, tails' sizes and checksums by which.

    The checksum of a concatenation is that of the head moved on by the tail's size, xor that of the tail.
    """
    out = np.zeros(len(which), np.uint32)
    order = np.argsort(sizes[which], kind="stable")
    moved, step = heads.copy(), 0
    of = sizes[which][order]
    for size in np.unique(of):
        for _ in range(int(size) - step):
            moved = _CRC[moved & np.uint32(255)] ^ moved >> np.uint32(8)
        step = int(size)
        own = order[np.searchsorted(of, size):np.searchsorted(of, size, side="right")]
        out[own] = moved[owner[own]] ^ tails[which[own]]
    return out


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n) of the runs of a slice after their edits; words as bytes of Latin-1, too short ones left out."""
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        offsets, codes, distinct = batch_words(run_text(batch.column("text")), lower=False)
        if not distinct:
            continue
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        long = sizes >= LEAST_LENGTH
        keep = long[codes]
        which, owner = codes[keep], rows_of(offsets)[keep]
        heads = np.fromiter((zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids), np.uint32, len(ids))
        tails = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
        h = crc_after(heads, sizes, tails, which, owner)
        hit = h % np.uint32(EDIT) == 0
        total = np.bincount(which[~hit], minlength=len(distinct))
        found: Counter = Counter()
        for w, x in zip(which[hit].tolist(), h[hit].tolist(), strict=True):
            run = distinct[w].decode().encode("latin-1")
            at = x % len(run)
            found[run[:at] + run[at + 1:]] += 1
        for w in np.flatnonzero(total):
            found[distinct[w].decode().encode("latin-1")] += int(total[w])
        rows = [(w, n) for w, n in found.items() if len(w) >= LEAST_LENGTH]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64()), strict=True)], ["word", "n"])


class Words:
    """Words of a batch with a mark at both ends, one after the other."""

    def __init__(self, words: list[bytes]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size + 2) - self.size - 2
        self.flat = np.frombuffer(b"".join([b"^%b$" % w for w in words]), np.uint8)
        self.word = np.repeat(np.arange(len(words)), self.size + 2)
        self.left = np.repeat(self.start + self.size + 2, self.size + 2) - np.arange(len(self.flat))  # letters to the end of the word

    def grams(self, q: int) -> np.ndarray:
        """The gram of ``q`` letters that begins at each place, with its length in the low bits; of no use where the word ends before."""
        code, n = np.zeros(len(self.flat), np.int64), len(self.flat)
        for i in range(q):
            code[:n - i] = code[:n - i] << 8 | self.flat[i:]
        return code << 3 | q

    def own_grams(self, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, gram and rank of the gram that begins at each place but the last of every word; ``grams`` (sorted) are the frequent ones."""
        place = np.flatnonzero(self.left >= SHORTEST)
        gram, rank = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        open_ = np.arange(len(place))
        for q in range(SHORTEST, LONGEST + 1):
            own = self.grams(q)[place[open_]]
            at = np.minimum(np.searchsorted(grams, own), max(len(grams) - 1, 0))
            frequent = grams[at] == own if len(grams) else np.zeros(len(own), bool)
            gram[open_], rank[open_] = own, np.where(frequent, counts[at] if len(counts) else 0, 0)
            open_ = open_[frequent & (self.left[place[open_]] > q)]
        return place, gram, rank

    def bounds(self, place: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """The most grams of each word that stand around one letter, which is the most that one edit touches."""
        change = np.zeros(len(self.flat) + 1, np.int64)
        change[place] += 1
        np.subtract.at(change, place + (gram & 7), 1)
        around = np.cumsum(change[:-1])
        return np.maximum.reduceat(around, self.start) if len(self.start) else around[:0]

    def chosen(self, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, slot, place in the word, gram) of the ``bound + 1`` rarest grams of each word, in one order for all words."""
        place, gram, rank = self.own_grams(grams, counts)
        word = self.word[place]
        order = np.lexsort((place, gram, mix(gram.view(np.uint64) * GOLD), rank, word))
        word, place, gram = word[order], place[order], gram[order]
        slot = np.arange(len(word)) - np.searchsorted(word, word)
        some = slot <= self.bounds(np.sort(place), gram[np.argsort(place)])[word]
        return word[some], slot[some], (place - self.start[word])[some], gram[some]


def _gram_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, n): how many places of the batch's words begin with each gram of any length."""
    for batch in batches:
        words = Words(batch.column("word").to_pylist())
        for q in range(SHORTEST, LONGEST + 1):
            gram, n = np.unique(words.grams(q)[words.left >= q], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], ["gram", "n"])


def _lists(grams: np.ndarray, counts: np.ndarray):
    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, slot, place, gram = Words(batch.column("word").to_pylist()).chosen(grams, counts)
            at = pa.array(word)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(slot.astype(np.int32)), pa.array(place.astype(np.int32)), batch.column("word").take(at),
                                              batch.column("n").take(at)], ["gram", "slot", "place", "word", "n"])
    return lists


def _whole(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key``, cut so that no list is split; what a batch leaves open is carried over."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        start = int(np.searchsorted(keys, keys[-1])) if len(keys) > 1 else 0
        if start or rest and rest[-1].column(key)[-1].as_py() != keys[0]:
            done = [*rest, batch.slice(0, start)] if start else rest
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            rest = []
        rest.append(batch.slice(start))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def near(words: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j, of equal length or j one longer, differ by one replaced or inserted letter."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros(len(i), bool)
    wide = int(min(size.max(initial=0), WIDE))
    left, right = np.zeros((len(words), wide), np.uint8), np.zeros((len(words), wide), np.uint8)
    some = np.flatnonzero(size <= WIDE)
    flat = np.frombuffer(b"".join([words[k] for k in some]), np.uint8)
    row = np.repeat(some, size[some])
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
    left[row, column] = flat
    right[row, wide - size[row] + column] = flat
    fits = (size[i] <= WIDE) & (size[j] <= WIDE)
    for a in range(0, len(i), PAIRS):
        own = a + np.flatnonzero(fits[a:a + PAIRS])
        x, y = i[own], j[own]
        other = left[x] != left[y]
        same = size[x] == size[y]
        ok = other.sum(axis=1) == 1
        k = np.flatnonzero(~same)
        front = other[k].argmax(axis=1)
        back = (right[x[k]] != right[y[k]])[:, ::-1].argmax(axis=1)
        ok[k] = front + back >= size[x[k]]
        out[own] = ok
    for k in np.flatnonzero(~fits):
        x, y = words[i[k]], words[j[k]]
        at = next((m for m in range(len(x)) if x[m] != y[m]), len(x))
        out[k] = x != y and (x[at + 1:] == y[at + 1:] if len(x) == len(y) else x[at:] == y[at + 1:])
    return out


def _pairs(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, other) for the others from ``first`` up to ``last`` of each row, about ``PAIRS`` at a time."""
    n = np.maximum(last - first, 0)
    ends, at = np.cumsum(n), 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        own = n[at:stop]
        if own.sum():
            row = np.repeat(np.arange(at, stop), own)
            yield row, np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first[at:stop], own)
        at = stop


class _Chosen:
    """The chosen grams of words as a matrix, to tell where a pair meets first."""

    def __init__(self, words: list[bytes], grams: np.ndarray, counts: np.ndarray):
        word, slot, place, gram = Words(words).chosen(grams, counts)
        wide = int(slot.max(initial=0)) + 1
        self.gram, self.place = np.zeros((len(words), wide), np.int64), np.full((len(words), wide), -9)
        self.gram[word, slot], self.place[word, slot] = gram, place

    def first(self, i: np.ndarray, j: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the first common gram of words i and j that an edit can leave at both its places."""
        shift = self.place[j][:, None, :] - self.place[i][:, :, None]
        both = (self.gram[i][:, :, None] == self.gram[j][:, None, :]) & (self.gram[i][:, :, None] > 0) & ((shift == 0) | (shift == 1) & longer[:, None, None])
        at = both.reshape(len(i), both.shape[1] * both.shape[2]).argmax(axis=1)
        return at // both.shape[2], at % both.shape[2]


NEAR = "word binary, n_near long, best_n long, best_word binary"


def _summed(words: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch | None:
    """A row for each word with near words in the batch: their number and the most frequent one, of equal ones the least."""
    if not len(i):
        return None
    a, b = np.append(i, j), np.append(j, i)
    names: dict[bytes, int] = {}
    number = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], number[a]))
    own = number[a][order]
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    best = b[order][head]
    return pa.RecordBatch.from_arrays([pa.array([words[k] for k in a[order][head]], pa.binary()), pa.array(np.diff(np.append(head, len(own)))), pa.array(n[best]),
                                       pa.array([words[k] for k in best], pa.binary())], [x.split()[0] for x in NEAR.split(", ")])


def _merge(grams: np.ndarray, counts: np.ndarray):
    """Near pairs of each list: words of one length that hold the gram at one place, and words one longer that hold it there or one later."""
    mask = (1 << 21) - 1

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, "gram"):
            size = np.fromiter(map(len, batch.column("word").to_pylist()), np.int64, batch.num_rows)
            gram = np.unique(np.asarray(batch.column("gram")), return_inverse=True)[1]
            place = np.asarray(batch.column("place")).astype(np.int64)

            def cell(size, place, gram=gram):
                return gram << 42 | (size & mask) << 21 | place & mask
            order = np.argsort(cell(size, place), kind="stable")
            size, place, gram, slot = size[order], place[order], gram[order], np.asarray(batch.column("slot"))[order]
            words, n = batch.column("word").take(pa.array(order)).to_pylist(), np.asarray(batch.column("n"))[order]
            key, chosen = cell(size, place, gram), _Chosen(words, grams, counts)
            found_i, found_j = [], []
            ranges = [(np.arange(len(key)) + 1, np.searchsorted(key, key, side="right"))]
            for more in (0, 1):
                other = cell(size + 1, place + more, gram)
                ranges.append((np.searchsorted(key, other), np.searchsorted(key, other, side="right")))
            for first, last in ranges:
                for i, j in _pairs(first, last):
                    ok = near(words, i, j)
                    i, j = i[ok], j[ok]
                    u, v = chosen.first(i, j, size[j] > size[i])
                    here = (u == slot[i]) & (v == slot[j])
                    found_i.append(i[here])
                    found_j.append(j[here])
            out = _summed(words, n, np.concatenate(found_i or [np.zeros(0, int)]), np.concatenate(found_j or [np.zeros(0, int)]))
            if out is not None:
                yield out
    return merge


def _deletions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (variant, word, n): hashes of a word and of the word without each of its letters."""
    import xxhash

    for batch in batches:
        rows = [(v, w, n) for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True)
                for v in {xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in (w, *(w[:k] + w[k + 1:] for k in range(len(w))))}]
        if rows:
            kinds = (pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["variant", "word", "n"])


def _merge_deletions(grams: np.ndarray, counts: np.ndarray, long: np.ndarray):
    """Near pairs that share a deletion and whose first common gram has one of the ``long`` lists."""
    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, "variant"):
            words, n = batch.column("word").to_pylist(), np.asarray(batch.column("n"))
            size = np.fromiter(map(len, words), np.int64, len(words))
            variant = np.unique(np.asarray(batch.column("variant")), return_inverse=True)[1]
            order = np.lexsort((size, variant))
            words, n, size, variant = [words[k] for k in order], n[order], size[order], variant[order]
            chosen = _Chosen(words, grams, counts)
            found_i, found_j = [], []
            for i, j in _pairs(np.arange(len(words)) + 1, np.searchsorted(variant, variant, side="right")):
                some = size[j] - size[i] <= 1
                i, j = i[some], j[some]
                ok = near(words, i, j)
                i, j = i[ok], j[ok]
                u, _ = chosen.first(i, j, size[j] > size[i])
                here = np.isin(chosen.gram[i, u], long)
                found_i.append(i[here])
                found_j.append(j[here])
            out = _summed(words, n, np.concatenate(found_i or [np.zeros(0, int)]), np.concatenate(found_j or [np.zeros(0, int)]))
            if out is not None:
                yield out
    return merge


def vocabulary(docs: DataFrame) -> DataFrame:
    """Words (bytes of Latin-1) with their number of occurrences after the edits, those of enough letters and occurrences."""
    def count(batches):
        return _count(part for batch in batches for part in slices(batch, "text", SLICE))
    found = modest_batches(docs).select("doc_id", "text").filter("text IS NOT NULL").mapInArrow(count, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def frequent_grams(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The grams that more than ``RARE`` words' places begin with, sorted, and their counts; at most ``DICTIONARY`` of each length."""
    places = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0))).first()[0]
    least = max(RARE, -(-places // DICTIONARY))
    counted = words.mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > least)
    got = sorted((r["gram"], r["n"]) for r in counted.toLocalIterator())  # places / least at most for each length
    return np.array([g for g, _ in got], np.int64), np.array([n for _, n in got], np.int64)


def near_words(words: DataFrame, longest_list: int = LIST) -> DataFrame:
    """Rows (word, n_near, best_n, best_word) for each word of ``words`` (word, n) that has near words.

    Lists of more than ``longest_list`` words, of grams that many words hold at their end or at full length, are not compared directly: their
    words meet by the deletions they share, at most a few letters' worth of words each, and count the pairs whose first common gram has such a list.
    """
    grams, counts = frequent_grams(words)
    lists = stored(words.mapInArrow(_lists(grams, counts), "gram long, slot int, place int, word binary, n long"), "variant-lists")
    most = max(longest_list, lists.count() // 100_000) if longest_list == LIST else longest_list
    long = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > most).select("gram")
    long_grams = np.array(sorted(r["gram"] for r in long.toLocalIterator()), np.int64)  # at most 100,000
    short = lists.filter(~F.col("gram").isin(long_grams.tolist())) if len(long_grams) and len(long_grams) <= 100 else lists.join(
        F.broadcast(long), "gram", "left_anti") if len(long_grams) else lists
    found = short.repartition("gram").sortWithinPartitions("gram").mapInArrow(_merge(grams, counts), NEAR)
    if len(long_grams):
        held = lists.join(F.broadcast(long), "gram", "left_semi").select("word", "n").distinct()
        variants = held.mapInArrow(_deletions, "variant long, word binary, n long").repartition("variant").sortWithinPartitions("variant")
        found = found.unionByName(variants.mapInArrow(_merge_deletions(grams, counts, long_grams), NEAR))
    best = F.min(F.struct(-F.col("best_n"), F.col("best_word"))).alias("best")
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n_near", (-F.col("best.col1")).alias("best_n"), F.col("best.best_word").alias("best_word"))


def group(docs: DataFrame, longest_list: int = LIST) -> DataFrame:
    """One row per word of all texts: word, form, root, n, n_near, form_n.

    Runs of letters (A-Z, a-z, U+00C0 to U+00FF) are lowered in A-Z only; runs whose document and letters give a checksum that ``EDIT`` divides lose a
    letter. Words are the results of at least six letters that occur five times or more. Near words differ by one inserted, deleted or replaced
    letter. ``form`` is the near word that occurs most (of equal ones the least), if it does so at least five times as often as the word, else null;
    ``root`` is the last of the forms that lead from the word, the word itself without any. Frequencies grow fivefold with each form, so that
    a path is short and a few rounds of doubling reach its end.

    Null and empty texts and texts without letters have no words; a null doc_id counts as empty text in the checksum. Repeated rows are
    counted each. Other columns are not read. An empty table gives no rows.
    """
    words = stored(vocabulary(docs), "variant-words")
    near_ = stored(near_words(words, longest_list), "variant-near")
    joined = words.join(near_, "word", "left").withColumn("led", F.col("best_n") >= RATIO * F.col("n"))
    out = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("led"), F.col("best_word")).alias("form"),
                               F.when(F.col("led"), F.col("best_n")).alias("form_n")), "variant-forms")
    roots = stored(out.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        onward = spread_join(roots, roots.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", F.col("word"), "left")
        onward = stored(onward, "variant-roots")
        roots = onward.select("word", F.coalesce("further", "root").alias("root"))
        if onward.filter("further IS NOT NULL").isEmpty():
            break
    text = {c: F.decode(c, "ISO-8859-1").alias(c) for c in ("word", "form", "root")}
    done = out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return done.select(text["word"], text["form"], text["root"], "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return group(read(spark, sf_dir, "documents"))
