"""Words of a batch of texts as numpy arrays, for functions that run on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


def batch_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Offsets of each text's words, the words as codes, and the distinct words.

    Words are runs of bytes other than ASCII white space; A-Z are lowered on request. Null texts have no words.
    """
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = texts.cast(pa.large_string()).fill_null("")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = np.asarray(lists.offsets, np.int64) - int(lists.offsets[0].as_py() if len(lists.offsets) else 0)
    if not len(flat):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), []
    coded = flat.dictionary_encode()
    codes, distinct = np.asarray(coded.indices).astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in distinct:  # white space at the ends of a text gives empty parts
        blank = distinct.index(b"")
        keep = codes != blank
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
        codes -= codes > blank
        del distinct[blank]
    return offsets, codes, distinct


def word_hashes(distinct: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, one for each position that has n words to its right within the array."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:m].copy()
        for i in range(1, n):
            out = mix(out * GOLD + hashes[i:i + m])
        return out


def rows_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def slices(batch: pa.RecordBatch, name: str = "text", most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch whose texts have together at most so many bytes, or that are one row: bounds what arrays over words take."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(name)).fill_null(0), np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.take(pa.array(np.arange(at, stop)))  # a copy: string kernels misread batches that start inside their buffers
        at = stop


def sliced(work, name: str = "text", most: int = 6 << 20):
    """A function of batches that gets them in ``slices``."""
    def parts(batches):
        for batch in batches:
            yield from slices(batch, name, most)
            pa.default_memory_pool().release_unused()  # else a worker keeps the most that any batch took
    return lambda batches: work(parts(batches))
