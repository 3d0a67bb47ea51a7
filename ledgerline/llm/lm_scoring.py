"""LM scoring: online logistic context mixing over hashed contexts.

The model predicts a text bit by bit. For each of several orders a predictor knows the
zeros and ones seen after the last bytes and the bits of the current byte so far. Two
mixers add the predictions up in the logistic domain, with weights chosen by a gate; an
adaptive map refines the first. A last mixer adds up these three with weights that move
along each text (``context_mixing``).

1. The texts are cut into parts as they are read; a part is stored with its different
   windows of bytes and their counts in the texts to learn from, compressed, in a row
   for each pair of last two context bytes.
2. The counts of a window are summed up over all parts, pair by pair. Pairs are dealt to
   blocks, as many as the windows need. Nothing is dropped, capped or sampled.
3. Each block learns weights online from its windows, each predicted from the counts
   without itself. The means of the blocks, by what their gates saw, are the weights.
   A second look at the windows gives the adaptive map.
4. A block works out what the mixers say of each of its windows, and deals that out to the
   parts that have them. Each part is scored where its windows and texts meet.

Only the weights, the map and the counts after one byte of context are on the driver;
their sizes are fixed. Beside the model's score there is the base score of a unigram
model over tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import context_mixing as mixing
from ledgerline.llm.common import release, remainder, run, stored
from ledgerline.sources import read_table

FOLDS, HELD_OUT = 7, 2
#: Words whose counts are sent to every task at most; the rest is joined.
HEAD_WORDS = 100_000
#: Bytes of text of a part, about, and of what a task works on at once; one text at least.
PART, CHUNK = 16_000_000, 4_000_000
#: Windows that a task deals to their parts at once, about.
DEALT = 500_000
#: The columns of the margins.
LAYERS = [f"layer{i}" for i in range(mixing.LAYERS)]
#: The windows of a pair in a row: the pair (their last two context bytes), how many, and these; and how many at most.
PRESSED, _PRESSED = ["pair", "many", "windows"], "pair bigint, many bigint, windows binary"
MOST_PRESSED = 1_000_000
#: Different windows of a block, about, and the number of blocks that there can be.
BLOCK_WINDOWS, MOST_BLOCKS = 50_000, 65_536


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def _raw(texts: pa.Array) -> list[bytes]:
    return pc.fill_null(texts, "").cast(pa.binary()).to_pylist()


def _pressed(grams: np.ndarray, n: np.ndarray) -> bytes:
    """Windows of one pair, in order, and their counts, compressed: all first bytes, all second ones, and so on.

    Of a window there are the four bytes that the pair does not tell, as the step from the one before.
    """
    rest = (grams >> np.uint64(24) << np.uint64(8) | grams & np.uint64(0xFF)).astype(np.uint32)
    planes = np.empty((12, len(grams)), np.uint8)
    planes[:4] = np.diff(rest, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
    planes[4:] = n.astype(np.int64).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpressed(pair: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows and counts that ``_pressed`` was given."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(12, -1)
    rest = np.cumsum(planes[:4].T.copy().view(np.uint32).ravel(), dtype=np.uint32).astype(np.uint64)
    grams = rest >> np.uint64(8) << np.uint64(24) | np.uint64(pair << 8) | rest & np.uint64(0xFF)
    return grams, planes[4:].T.copy().view(np.int64).ravel()


def _pair_rows(grams: np.ndarray, n: np.ndarray) -> list[tuple[int, int, bytes]]:
    """pair, number of windows, and these compressed, of different windows in order, with their counts.

    The windows after the same two bytes are a pair's; MOST_PRESSED at most are in one row.
    """
    pair = (grams >> np.uint64(8)).astype(np.uint16)
    order = np.argsort(pair, kind="stable")
    pair, grams, n = pair[order], grams[order], n[order]
    edges = np.flatnonzero(np.diff(pair.astype(np.int64), prepend=-1, append=-1)).tolist()
    cuts = [(a, min(a + MOST_PRESSED, e)) for s, e in zip(edges[:-1], edges[1:], strict=True) for a in range(s, e, MOST_PRESSED)]
    return [(int(pair[a]), b - a, _pressed(grams[a:b], n[a:b])) for a, b in cuts]


def _summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different windows in order, and the sums of their counts."""
    order = np.argsort(grams)
    grams, n = grams[order], n[order]
    edges = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    return grams[edges], np.add.reduceat(n, edges)


def _boxed(texts: pa.RecordBatch) -> bytes:
    """The rows, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(texts)
    return sink.getvalue().to_pybytes()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts with the row that they got, some in a row of their part, and the windows of the part by pair."""
    part = row = TaskContext.get().partitionId() << 36
    for batch in _chunks(batches, PART):
        found, boxes = [], []
        for texts in _chunks(iter([batch]), CHUNK):
            grams, sizes = mixing.windows(_raw(texts["text"]))
            code, different = pd.factorize(grams)
            learned = np.repeat(texts["learn"].to_numpy(zero_copy_only=False), sizes)
            found.append((different, np.bincount(code, learned, len(different)).astype(np.int64)))
            del grams, code, learned
            numbered = [pa.array(np.arange(row, row + texts.num_rows)), texts["doc_id"], texts["held_out"], pc.fill_null(texts["text"], "")]
            boxes.append(_boxed(pa.RecordBatch.from_arrays(numbered, ["row", "doc_id", "held_out", "text"])))
            row += texts.num_rows
        pairs, many, raw = zip(*_pair_rows(*_summed(*(np.concatenate(v) for v in zip(*found, strict=True)))), strict=True)
        none, rows = [None] * len(boxes), len(boxes) + len(pairs)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
        columns = (boxes + [None] * len(pairs), *(none + list(c) for c in (pairs, many, raw)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(rows, part)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["part", "texts", *PRESSED],
        )
        part += 1


def _rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, int | None, np.ndarray, np.ndarray]]:
    """key, part, windows and counts of each row."""
    for batch in batches:
        columns = (batch[c].to_pylist() for c in (key, "part", "pair", "windows"))
        for k, part, pair, raw in zip(*columns, strict=True):
            yield k, part, *_unpressed(pair, raw)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of each pair once, with the sums of their counts, from rows sorted by pair."""
    for _, rows in groupby(_rows(batches, "pair"), itemgetter(0)):
        grams, n = (np.concatenate(v) for v in list(zip(*rows, strict=True))[2:])
        pairs, many, raw = zip(*_pair_rows(*_summed(grams, n)), strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs, pa.int64()), pa.array(many, pa.int64()), pa.array(raw, pa.binary())], PRESSED
        )


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that come one in a row, by pair."""
    for batch in batches:
        if batch.num_rows:
            made = _pair_rows(*_summed(batch["gram"].to_numpy().view(np.uint64), batch["n"].to_numpy()))
            pairs, many, raw = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs, pa.int64()), pa.array(many, pa.int64()), pa.array(raw, pa.binary())], PRESSED
            )


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a byte came after a byte: 65,536 rows at most."""
    counts = np.zeros(65_536, np.int64)
    for _, _, grams, n in _rows(batches, "pair"):
        # whole numbers, exact as doubles
        counts += np.bincount((grams & np.uint64(0xFFFF)).astype(np.int64), n, 65_536).astype(np.int64)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["pair", "n"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows of each block and their counts, from rows sorted by block."""
    for _, rows in groupby(_rows(batches, "block"), itemgetter(0)):
        yield tuple(np.concatenate(v) for v in list(zip(*rows, strict=True))[2:])


def _seen(near, batches: Iterator[pa.RecordBatch]):
    """Inputs, gates, bits and weights of the windows to learn from, block by block."""
    for grams, n in _blocks(batches):
        zeros, ones = mixing.counts_of(grams, n, near)
        zeros, ones = mixing.without_itself(grams, n, zeros, ones)
        real = np.flatnonzero(n)
        # in no order that has to do with the text, but the same at every try
        real = real[np.argsort(mixing._mixed(grams[real]), kind="stable")]
        x, gates = mixing.inputs(zeros[real], ones[real])
        yield x, gates, mixing.bits_of(grams[real]), np.sqrt(n[real])


def _learned(near, start) -> Callable:
    """For each gate of each mixer: the weights times what the gate saw, and that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, gates, bits, each in _seen(near.value, batches):
            for kind, (weights, gate) in enumerate(zip(start.value, gates, strict=True)):
                weights, seen = mixing.learned(weights, x, gate, bits, each)
                at, i = np.nonzero(np.broadcast_to(seen[:, None] > 0, weights.shape))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), kind)), pa.array(at), pa.array(i),
                     pa.array(weights[at, i] * seen[at]), pa.array(seen[at])],
                    ["kind", "gate", "i", "value", "seen"],
                )

    return run


def _mapped(near, weights) -> Callable:
    """For each gate and point of the adaptive map: the ones, and all bits seen there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, ones = np.zeros((2, mixing.GATES[0], mixing.BUCKETS))
        for x, gates, bits, each in _seen(near.value, batches):
            at = (gates[0], mixing.nearest(mixing.sums(weights.value[0], x, gates[0])))
            np.add.at(hits, at, each[:, None])
            np.add.at(ones, at, each[:, None] * bits)
        gate, i = np.nonzero(hits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(gate), np.int64)), pa.array(gate), pa.array(i),
             pa.array(ones[gate, i]), pa.array(hits[gate, i])],
            ["kind", "gate", "i", "value", "seen"],
        )

    return run


def _told(near, model) -> Callable:
    """part, window and its margins, a long for each layer, of the rows with a part.

    Rows come sorted by block, those without a part, which have all windows, first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches, "block"), itemgetter(0)):
            held, every, layers = [], None, None
            for _, part, grams, n in rows:
                if part is None:
                    held.append((grams, n))
                    continue
                if every is None:
                    every, n = (np.concatenate(v) for v in zip(*held, strict=True))
                    order = np.argsort(every)
                    every, held = every[order], []
                    zeros, ones = mixing.counts_of(every, n[order], near.value)
                    layers = np.empty((len(every), mixing.LAYERS), np.int64)
                    for a in range(0, len(every), 20_000):
                        some = slice(a, a + 20_000)
                        margins = model.value.margins(every[some], zeros[some], ones[some])
                        layers[some] = mixing.rounded(margins).view(np.int64)[:, :, 0]
                    del zeros, ones
                found = layers[np.searchsorted(every, grams)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams), part)), pa.array(grams.view(np.int64)),
                     *(pa.array(found[:, i]) for i in range(mixing.LAYERS))],
                    ["part", "gram", *LAYERS],
                )

    return run


def cut(documents: DataFrame, learn: Column) -> DataFrame:
    """Texts and windows in parts; ``learn`` says which texts the model learns from."""
    ready = documents.select(
        F.col("doc_id").cast("bigint"),
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        F.col("text").cast("string"),
        learn.alias("learn"),
    )
    return stored(
        ready.mapInArrow(
            _cut, f"part bigint, texts binary, {_PRESSED}"
        ),
        "lm-parts",
    )


def merged(rows: DataFrame) -> DataFrame:
    """The windows of all ``rows`` (pair, many, windows) once, with the sums of their counts."""
    dealt = rows.select(F.lit(None).cast("bigint").alias("part"), "pair", "windows").repartition("pair")
    return stored(dealt.sortWithinPartitions("pair").mapInArrow(_merged, _PRESSED), "lm-windows")


def fitted(spark: SparkSession, windows: DataFrame) -> tuple[Broadcast, Broadcast, Column]:
    """Counts after one byte, the model, and the block of a row, of ``windows`` as ``merged`` gives them."""
    every = windows.withColumn("part", F.lit(None).cast("bigint"))
    # 65,536 rows at most
    first = every.mapInArrow(_near, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    near = spark.sparkContext.broadcast(
        mixing.near_counts(np.array([r.pair for r in first], np.int64), np.array([r.n for r in first], float))
    )
    different = windows.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    many = min(max(different // BLOCK_WINDOWS, 1), MOST_BLOCKS)
    block = F.pmod(F.xxhash64("pair"), F.lit(many)).cast("int").alias("block")
    dealt = every.select(block, "part", "pair", "windows").repartition("block").sortWithinPartitions("block")
    schema = "kind bigint, gate bigint, i bigint, value double, seen double"

    def summed(function: Callable) -> list:
        # as many rows as there are weights, or points of the map
        sums = dealt.mapInArrow(function, schema).groupBy("kind", "gate", "i")
        return sums.agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")).collect()

    weights = mixing.start()
    begin = spark.sparkContext.broadcast(weights)
    weights = [w.copy() for w in weights]
    for r in summed(_learned(near, begin)):
        weights[r.kind][r.gate, r.i] = r.value / r.seen
    shared = spark.sparkContext.broadcast(weights)
    refined = mixing.map_start()
    for r in summed(_mapped(near, shared)):
        refined[r.gate, r.i] += r.seen / (r.seen + 50) * (r.value / r.seen - refined[r.gate, r.i])
    for value in (begin, shared):
        value.unpersist()
    return near, spark.sparkContext.broadcast(mixing.Model(weights, refined)), block


def told(windows: DataFrame, rows: DataFrame, block: Column) -> DataFrame:
    """``rows`` (part, pair, windows) and all ``windows`` by block, for ``_told``."""
    every = windows.select(block, F.lit(None).cast("bigint").alias("part"), "pair", "windows")
    together = every.union(rows.select(block, "part", "pair", "windows")).repartition("block")
    return together.sortWithinPartitions("block", F.col("part").asc_nulls_first())


def learn_model(spark: SparkSession, windows: DataFrame) -> tuple[mixing.Model, DataFrame]:
    """The model of the counted ``windows`` (gram, n), and gram and margins of each."""
    every = merged(windows.select("gram", "n").mapInArrow(_grouped, _PRESSED))
    near, model, block = fitted(spark, every)
    columns = ["part", "gram", *LAYERS]
    made = told(every, every.withColumn("part", F.lit(0).cast("bigint")), block).mapInArrow(
        _told(near, model), ", ".join(f"{c} bigint" for c in columns)
    )
    return model.value, stored(made.drop("part"), "lm-margins")


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Offsets of the texts in the words, and the words; blank ones stand for none."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    return words.offsets.to_numpy(), words.flatten().dictionary_encode()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches, CHUNK):
        _, words = _tokens(batch["text"])
        counts = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
        made = pa.RecordBatch.from_arrays([words.dictionary, pa.array(counts)], ["word", "c"])
        yield made.filter(pc.not_equal(words.dictionary, ""))


def word_counts(documents: DataFrame) -> DataFrame:
    """word and its count c in the texts of ``documents``."""
    counted = documents.select(F.col("text").cast("string")).mapInArrow(
        _count_words, "word string, c bigint"
    )
    return stored(counted.groupBy("word").agg(F.sum("c").alias("c")), "lm-words")


def _packed(grams: np.ndarray, margins: np.ndarray) -> bytes:
    """Different windows in order and their margins, compressed: all first bytes, all second ones, and so on.

    Of a window there is the step from the one before, and of the layers after the first
    what they differ from it by, modulo 256: both are mostly small. The odds of a one are
    the same for windows that share the context and the bits so far: of these there is
    what they differ from the window before by, mostly nothing.
    """
    grams = grams.view(np.uint64)
    zero = mixing.bits_of(grams).T == 0
    planes = np.empty((8 * (1 + mixing.LAYERS), len(grams)), np.uint8)
    planes[:8] = np.diff(grams, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    layers = margins.view(np.uint8).reshape(-1, mixing.LAYERS, 8).transpose(1, 2, 0).copy()
    layers[1:] -= layers[:1]
    np.negative(layers, out=layers, where=zero)
    for bit in range(8):
        node = grams >> np.uint64(8 - bit)
        for layer, plane in zip(layers[:, bit], planes[8 + bit :: 8], strict=True):
            plane[:1] = layer[:1]
            plane[1:] = layer[1:] - layer[:-1] * (node[1:] == node[:-1])
    margins = planes[8:].reshape(layers.shape)
    np.negative(margins, out=margins, where=zero)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows and margins that ``_packed`` was given."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8 * (1 + mixing.LAYERS), -1)
    grams = np.cumsum(planes[:8].T.copy().view(np.uint64).ravel())
    zero = mixing.bits_of(grams).T == 0
    layers = planes[8:].reshape(mixing.LAYERS, 8, -1).copy()
    np.negative(layers, out=layers, where=zero)
    for bit in range(8):
        node = grams >> np.uint64(8 - bit)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        size = np.diff(np.append(first, len(node)))
        for layer in layers[:, bit]:
            running = np.cumsum(layer, dtype=np.uint8)
            layer[:] = running - np.repeat(running[first] - layer[first], size)
    np.negative(layers, out=layers, where=zero)
    layers[1:] += layers[:1]
    return grams.view(np.int64), layers.transpose(2, 0, 1).copy().view(np.int8)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows and margins put together by part, in few rows."""
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        part, grams, *layers = (np.concatenate(v) for v in zip(*held, strict=True))
        order = np.lexsort((grams.view(np.uint64), part))
        part, grams, layers = part[order], grams[order], np.stack(layers, axis=1)[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        raw = [_packed(grams[a:b], layers[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]]), pa.array(raw, pa.binary())], ["part", "told"])

    for batch in batches:
        held.append([batch[c].to_numpy() for c in ["part", "gram", *LAYERS]])
        size += batch.num_rows
        if size > DEALT:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def _scored(head, ends: int) -> Callable:
    """For each text: its ids, the score, and the tokens that ``head`` lacks.

    Rows come sorted by part, the windows of a part before its texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, index, margins = None, [], None, None
        for batch in batches:
            parts, kinds = batch["part"].to_numpy(), batch["kind"].to_numpy()
            edges = np.flatnonzero(np.diff(parts * 2 + kinds, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                piece = batch.slice(a, b - a)
                if parts[a] != part:
                    part, held, index, margins = parts[a], [], None, None
                if kinds[a] == 0:
                    held.extend(_unpacked(raw) for raw in piece["told"].to_pylist())
                    continue
                if index is None:
                    grams, margins = (np.concatenate(v) for v in zip(*held, strict=True))
                    index, held = pd.Index(grams), []
                for raw in piece["texts"]:
                    texts = pa.ipc.open_stream(raw.as_buffer()).read_next_batch()
                    grams, sizes = mixing.windows(_raw(texts["text"]))
                    codes = index.get_indexer(grams.view(np.int64))
                    yield _row(texts, mixing.mixed_online(margins, codes, sizes), head.value, ends)

    return run


def _row(batch: pa.RecordBatch, scores: np.ndarray, known: dict[str, int], ends: int) -> pa.RecordBatch:
    offsets, words = _tokens(batch["text"])
    names = words.dictionary.to_pylist()
    blank = np.fromiter((w == "" for w in names), bool, len(names))
    c = np.fromiter((known.get(w, 0) for w in names), np.int64, len(names))
    index = words.indices.to_numpy()
    real, there = ~blank[index], c[index] > 0
    running = lambda v: np.diff(np.append(0, np.cumsum(v))[offsets])
    logs = np.log10(c + 1.0)
    # sums within each text only, as a running sum over all would lose digits
    base = np.array([logs[index[a:b]].sum() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    rest = index[real & ~there]
    places = np.append(0, np.cumsum(running(real & ~there))).astype(np.int32)
    tail = pa.ListArray.from_arrays(
        pa.array(places), words.dictionary.take(pa.array(rest)).cast(pa.string())
    )
    return pa.RecordBatch.from_arrays(
        [
            batch["row"],
            batch["doc_id"],
            batch["held_out"],
            pa.array(running(real) + 1),
            pa.array(running(real & there) + (ends > 0)),
            pa.array(base + np.log10(ends + 1.0)),
            pa.array(scores),
            pc.binary_length(batch["text"]).cast(pa.int64()),
            tail,
        ],
        ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes", "tail"],
    )


@run("lm-scored")
def score(documents: DataFrame, learn: Column) -> DataFrame:
    """One row per row of ``documents`` with the base score and the model's score.

    ``learn`` is a condition on ``documents``: both models learn from the texts where it
    is true. A null text counts as an empty one: it has the end as its only token, and
    only the end as what the model predicts. A null id gives a null held_out. Repeated
    rows are scored, and learned from, as often as they are there. Where nothing is to be
    learned from, every bit is even.
    """
    spark = documents.sparkSession
    learn = F.coalesce(learn, F.lit(False))
    training = documents.filter(learn)
    counts, ends = word_counts(training), training.count()
    powers = [1 << k for k in range(0, 62)]
    n, v, *at_least = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)),
        F.count("*"),
        *[F.count(F.when(F.col("c") >= p, 1)).alias(f"at_least_{p}") for p in powers],
    ).first()
    n, v = n + ends, v + (ends > 0)
    least = next((p for p, m in zip(powers, at_least, strict=True) if m <= HEAD_WORDS), powers[-1])
    head = {r.word: r.c for r in counts.filter(F.col("c") >= least).collect()}

    parts = cut(documents, learn)
    windows = parts.filter(F.col("pair").isNotNull())
    different = merged(windows)
    near, model, block = fitted(spark, different)
    release(spark)  # the shuffles so far, which nothing reads again
    texts = parts.filter(F.col("pair").isNull()).select("part", F.lit(1).alias("kind"), "texts")
    margins = _told(near, model)
    given = (
        told(different, windows, block)
        .mapInArrow(lambda batches: _dealt(margins(batches)), "part bigint, told binary")
        .withColumn("kind", F.lit(0))
    )
    together = texts.unionByName(given, allowMissingColumns=True).repartition("part")
    made = stored(
        together.sortWithinPartitions("part", "kind").mapInArrow(
            _scored(spark.sparkContext.broadcast(head), ends),
            "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
            "logs double, score double, n_bytes bigint, tail array<string>",
        ),
        "lm-scores",
    )
    found = (
        made.select("row", F.explode("tail").alias("word"))
        .join(counts.filter(F.col("c") < least), "word")
        .groupBy("row")
        .agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"))
    )
    return made.drop("tail").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (
            F.col("logs")
            + F.coalesce("more_logs", F.lit(0.0))
            - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
        ).alias("base_score"),
        "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document, by what the documents outside fold 2 of 7 teach."""
    documents = read_table(spark, folder, "documents").select("doc_id", "text")
    return score(documents, F.coalesce(remainder("doc_id", FOLDS) != HELD_OUT, F.lit(True)))
