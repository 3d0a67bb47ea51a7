"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Items and texts are sequences of words. A document holds an item if a run of its
words is within an edit distance of a fifth of the item's words.

Such a run shares many word trigrams with the item: an edit spoils three at most, so
at least L - 2 - 3 * distance are left. Where so many are found, windows as long as
the item are laid over the place, one from each word. The CGK random walk turns a
window into a string in which an edit changes few places; keys of places sampled
from several walks meet those of the items. Pairs with a common key are checked by
exact edit distance.

The items are a small table. Their words go to every task in blocks of a checked
size; a larger table takes more blocks, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import left_out, run, text_of
from ledgerline.llm.word_hashes import hashed_words, inside, mixed, parts, shingles
from ledgerline.sources import read_table

#: Largest edit distance, as one in so many words of the item.
WORDS_PER_EDIT = 5
#: Items with fewer words are too short to tell from chance, and are not searched.
ITEM_WORDS = 6
GRAM = 3
#: Items and characters of a block at most.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 20_000_000
#: Walks, keys of each walk, and places in a key. At a fifth of the words edited
#: about half of the places agree, so that a pair without any common key of 64 is
#: one in thousands.
WALKS = 8
KEYS = 8
PLACES = 3
_PAD = np.uint64(0)


def embed(windows: np.ndarray, walk: int) -> np.ndarray:
    """The CGK string of each row of word hashes: three places for each word.

    At each place the word under the pointer is written; a bit that depends on the
    place and the word moves the pointer on or not. Behind the last word is padding.
    """
    n, length = windows.shape
    seeds = np.random.default_rng(walk).integers(1, 2**63, 3 * length, np.uint64) | np.uint64(1)
    padded = np.column_stack([windows, np.full(n, _PAD)])
    rows, at = np.arange(n), np.zeros(n, np.int64)
    out = np.empty((n, 3 * length), np.uint64)
    for place, seed in enumerate(seeds):
        word = padded[rows, at]
        out[:, place] = word
        at = np.minimum(at + (mixed(word ^ seed) >> np.uint64(63)).astype(np.int64), length)
    return out


def keys(windows: np.ndarray) -> np.ndarray:
    """A row of WALKS * KEYS keys for each row of word hashes."""
    n, length = windows.shape
    out = np.empty((n, WALKS * KEYS), np.uint64)
    for walk in range(WALKS):
        string = embed(windows, walk)
        # the pointer is at the end after about two places a word; behind is padding
        places = np.random.default_rng((walk, length)).integers(0, 2 * length, (KEYS, PLACES))
        for k in range(KEYS):
            key = np.full(n, np.uint64(walk * KEYS + k + 1))
            for place in places[k]:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + string[:, place])
            out[:, walk * KEYS + k] = key
    return out


def closest(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to any run of ``words``; start and end of a run."""

    def ends(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        places = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else places.copy()
        for i, word in enumerate(a, 1):
            step = np.minimum(row[:-1] + (b != word), row[1:] + 1)
            row = np.minimum.accumulate(np.append(i, step) - places) + places
        return row

    row = ends(item, words, True)
    end = int(row.argmin())
    back = ends(item[::-1], words[:end][::-1], False)
    # of the runs that end there, the shortest
    return int(row[end]), end - int(np.flatnonzero(back == row[end])[0]), end


@dataclass
class Items:
    """Word hashes of a block of items, their trigrams and their keys."""

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray = field(init=False)
    owners: np.ndarray = field(init=False)
    sieve: np.ndarray = field(init=False)
    tables: list[set[int]] = field(init=False)

    def __post_init__(self) -> None:
        grams = [shingles(w, GRAM) for w in self.words]
        flat = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(flat, kind="stable")
        self.grams = flat[order]
        self.owners = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.places = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])[order]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(flat >> np.uint64(42)).astype(np.int64)] = True
        self.tables = [set(keys(w[None, :])[0].tolist()) for w in self.words]

    def found(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, distance) of each text and item that it holds."""
        grams = shingles(words, GRAM)
        whole, text = inside(offsets, GRAM, len(words))
        at = np.flatnonzero(whole)[self.sieve[(grams[whole] >> np.uint64(42)).astype(np.int64)]]
        low = np.searchsorted(self.grams, grams[at], "left")
        high = np.searchsorted(self.grams, grams[at], "right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        if not len(at):
            return
        counts = high - low
        which = np.repeat(low - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
        place = np.repeat(at, counts)
        item = self.owners[which]
        holder = np.searchsorted(offsets, place, "right") - 1
        order = np.lexsort((place, item, holder))
        place, item, holder, where = place[order], item[order], holder[order], self.places[which][order]
        edges = np.flatnonzero(
            (np.diff(holder, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0)
        ).tolist() + [len(place)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            best = self._best(words, offsets, int(holder[a]), int(item[a]), place[a:b], where[a:b])
            if best is not None:
                yield int(holder[a]), int(item[a]), *best

    def _best(self, words, offsets, holder, item, place, where):
        own = self.words[item]
        length, most = len(own), len(own) // WORDS_PER_EDIT
        least = max(1, length - GRAM + 1 - GRAM * most)
        # different trigrams of the item within the widest run that could match it
        if len(place) < least:
            return None
        begin, end = int(offsets[holder]), int(offsets[holder + 1])
        starts = np.unique(
            (place - where)[:, None] + np.arange(-most, most + 1)[None, :]
        )
        starts = starts[(starts >= begin - most) & (starts < end)]
        near = np.searchsorted(place, starts + length + most) - np.searchsorted(place, starts - most)
        starts = starts[near >= least]
        if not len(starts):
            return None
        spots = starts[:, None] + np.arange(length)[None, :]
        windows = np.where(
            (spots >= begin) & (spots < end), words[np.clip(spots, begin, end - 1)], _PAD
        )
        hit = np.array([not self.tables[item].isdisjoint(k) for k in keys(windows).tolist()])
        best = None
        reach = -1
        for start in starts[hit].tolist():
            if start <= reach:  # the region of an earlier start has it already
                continue
            reach = start + 2 * most
            a, b = max(begin, start - most), min(end, start + length + 3 * most + 1)
            distance, first, last = closest(own, words[a:b])
            if distance <= most and (best is None or distance < best[2]):
                best = (a + first - begin, a + last - begin, distance)
        return best


def _search(items) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        for batch in parts(batches):
            offsets, words = hashed_words(batch["text"])
            rows = [
                (text, block.ids[item], start, end, distance, len(block.words[item]))
                for text, item, start, end, distance in block.found(words, offsets)
            ]
            if rows:
                text, *rest = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(text)), *(pa.array(c, pa.int64()) for c in rest)],
                    ["doc_id", "item_id", "start_word", "end_word", "distance", "item_words"],
                )

    return run


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that it holds.

    doc_id, item_id, start_word and end_word (exclusive) of the closest run of words,
    its distance in words, and the item's number of words. Of several closest runs
    the first is given. Null and empty texts hold nothing; items with a null text or
    under ITEM_WORDS words are in nothing. Rows given twice are found twice.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).filter(
        F.col("text").isNotNull()
    )
    count, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, ceil(count / BLOCK_ITEMS), ceil(chars / BLOCK_CHARS))
    ready = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = None
    for block in range(blocks):
        rows = items.filter(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block
        ).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id, r.text))
        offsets, words = hashed_words(pa.array([r.text for r in rows], pa.string()))
        own = [words[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        kept = [i for i, w in enumerate(own) if len(w) >= ITEM_WORDS]
        sent = spark.sparkContext.broadcast(Items([rows[i].item_id for i in kept], [own[i] for i in kept]))
        found = ready.mapInArrow(
            _search(sent),
            "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, "
            "distance bigint, item_words bigint",
        )
        out = found if out is None else out.union(found)
    return out


@run("decontamination-held")
def holding(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The hash of each text that holds an item."""
    named = documents.select(F.xxhash64(text_of()).alias("doc_id"), "text")
    return leaks(named, benchmark).select("doc_id").distinct()


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text holds no item, with all their columns.

    Each row is judged by its own text, whatever its doc_id.
    """
    held = holding(documents, benchmark)
    return left_out(documents, held, lambda row: [F.xxhash64(F.coalesce(row["text"], F.lit("")))])


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The leaks of every item of ``benchmark`` into every document."""
    return leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
