"""Words and shingles of texts as integers, for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    r"""Offsets of the texts in their words, and a 64-bit hash of each word.

    Words are ``[^\x20\x09-\x0D]+`` with A-Z in lower case. Null and empty texts have
    none. Each different word of the batch is hashed once.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = split.offsets.to_numpy().astype(np.int64)
    words = split.flatten().dictionary_encode()
    names = words.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    real = np.fromiter(map(bool, names), bool, len(names))
    index = words.indices.to_numpy()
    kept = real[index]
    return np.append(0, np.cumsum(kept))[offsets], hashes[index[kept]]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, wherever a text ends; none if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mixed(out * _ODD + words[k : k + n])
    return out


def inside(offsets: np.ndarray, size: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ``shingles`` lie within one text, and the text of each of those."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = max(total - size + 1, 0)
    whole = text[:n] == text[size - 1 : size - 1 + n]
    return whole, text[:n][whole]


def parts(batches: Iterator[pa.RecordBatch], most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``most`` bytes of ``text`` each, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        start, size = 0, 0
        for i, n in enumerate(sizes):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)
