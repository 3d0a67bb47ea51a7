"""Toxicity: compression-distance classification.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A
window is one word of a text. How much shorter it becomes under the toxic
dictionary than under the ordinary one is its distance. Windows are compared with
thresholds calibrated on ordinary documents; a logistic curve over what exceeds
them gives the score of the document.

The dictionaries, thresholds and weights are learned from a bounded sample of
labelled documents. All documents are scored whole. Each different word of a
batch is compressed once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, remainder
from ledgerline.sources import read_table

#: About so many toxic and ordinary documents at most are learned from, and of
#: these only those up to so many characters.
TOXIC_DOCUMENTS = 3_000
ORDINARY_DOCUMENTS = 6_000
DOCUMENT_CHARS = 20_000
#: Bytes of the dictionaries at most.
TOXIC_BYTES = 2_048
ORDINARY_BYTES = 16_384
#: Words go into the toxic dictionary if this share of the toxic documents, and
#: this many times the share of the ordinary ones, hold them.
HOLDERS = 0.004
CONTRAST = 4
#: Bytes after a word, so that the compressor looks for matches in all of it.
PAD = b" " * 16
#: Shares of an ordinary document's windows above each of the thresholds.
ABOVE = (0.01, 0.001, 0.0001)
FOLDS = 5


def compressed(dictionary: bytes, windows: list[bytes]) -> np.ndarray:
    """The compressed length of each window under a dictionary."""
    if not windows:
        return np.zeros(0, np.int64)
    # the library refuses segments without any bytes; PAD keeps all of them filled
    made = _compressor(dictionary).multi_compress_to_buffer([w + PAD for w in windows], threads=0)
    return np.fromiter((len(made[i]) for i in range(len(made))), np.int64, len(made))


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2,
        min_match=4,
        window_log=14,
        hash_log=14,
        chain_log=14,
        search_log=4,
        target_length=32,
        write_content_size=0,
        write_dict_id=0,
        write_checksum=0,
    )
    ready = zstandard.ZstdCompressionDict(dictionary)
    ready.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=ready, compression_params=parameters)


def _trained(words: list[bytes], holders: np.ndarray, size: int) -> bytes:
    """A dictionary trained on words, each given as often as documents hold it, to 50."""
    times = np.minimum(holders, 50)
    each = np.repeat(np.arange(len(words)), times)
    order = np.random.default_rng(0).permutation(len(each))[:30_000]
    chosen = [words[i] + PAD for i in each[order]]
    try:
        return zstandard.train_dictionary(size, chosen).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer: their bytes themselves
        return b"".join(dict.fromkeys(chosen))[-size:].rjust(8, b" ")


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Offsets of the texts in their words, and the words; a blank one stands for none."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    return words.offsets.to_numpy(), words.flatten().dictionary_encode()


def _holders(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Words in order, and the documents that hold each.

    Near copies, told by the least or the greatest of their word hashes, count once.
    """
    offsets, words = _split(texts)
    names = words.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    index = words.indices.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    counts = []
    for extreme in (np.minimum, np.maximum):
        mark = extreme.reduceat(hashes[index], offsets[:-1][sizes > 0])
        pairs = np.unique(index << 32 | np.repeat(mark, sizes[sizes > 0]))
        counts.append(np.bincount(pairs >> 32, minlength=len(names)))
    held = np.minimum(*counts)
    order = [i for i in sorted(range(len(names)), key=names.__getitem__) if names[i]]
    return [names[i] for i in order], held[order]


@dataclass(frozen=True)
class Model:
    """What was learned. Without documents of both labels the score is ``prior``."""

    prior: float
    toxic: bytes = b""
    ordinary: bytes = b""
    thresholds: tuple[float, ...] = ()
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def distances(self, windows: list[bytes]) -> np.ndarray:
        return compressed(self.ordinary, windows) - compressed(self.toxic, windows)

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row for each text; a null or empty one has no windows."""
        offsets, flat = _split(texts)
        names = flat.dictionary.cast(pa.binary()).to_pylist()
        index = flat.indices.to_numpy()
        each = self.distances(names)[index]
        real = np.fromiter(map(bool, names), bool, len(names))[index]
        found = np.zeros((len(texts), 6))
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            row = each[a:b][real[a:b]]
            if len(row):
                top = np.partition(row, -3)[-3:] if len(row) > 3 else row
                found[i] = (top.max(), top.mean(), *((row > t).sum() for t in self.thresholds), len(row))
        found[:, 2:] = np.log1p(found[:, 2:])
        return np.column_stack([np.ones(len(found)), found, found[:, 0] ** 2])

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        x = (self.features(texts) - np.array(self.centre)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -40, 40)))


def learn(texts: pa.Array | list[str], toxic: list[int], prior: float) -> Model:
    """A model from labelled texts; ``prior`` is the share of toxic labels overall."""
    marked = np.array(toxic, bool)
    if marked.all() or not marked.any():
        return Model(prior)
    whole = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    bad, bad_held = _holders(whole.filter(pa.array(marked)))
    plain, plain_held = _holders(whole.filter(pa.array(~marked)))
    n_bad, n_plain = int(marked.sum()), int((~marked).sum())
    at = pc.index_in(pa.array(bad, pa.binary()), pa.array(plain, pa.binary()))
    both = np.append(plain_held, 0)[pc.fill_null(at, len(plain)).to_numpy()]
    chosen = (bad_held >= max(3, HOLDERS * n_bad)) & (
        bad_held / n_bad >= CONTRAST * (both + 0.5) / n_plain
    )
    if not chosen.any():
        chosen[:] = True
    toxic_dictionary = _trained(
        [w for w, c in zip(bad, chosen, strict=True) if c], bad_held[chosen], TOXIC_BYTES
    )
    model = Model(prior, toxic_dictionary, _trained(plain, plain_held, ORDINARY_BYTES))
    away = np.repeat(model.distances(plain), plain_held) if plain else np.zeros(1)
    model = replace(model, thresholds=tuple(float(np.quantile(away, 1 - share)) for share in ABOVE))
    x = model.features(whole)
    centre, scale = x.mean(0), x.std(0)
    centre[0], scale[scale == 0] = 0, 1
    weights = _logistic(
        (x - centre) / scale,
        marked.astype(float),
        np.where(marked, prior / n_bad, (1 - prior) / n_plain) * len(texts),
    )
    return replace(model, centre=tuple(centre), scale=tuple(scale), weights=tuple(weights))


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (each * (p - y)) + 0.01 * w
        w -= np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), slope)
    return w


def training_texts(
    documents: DataFrame,
    labels: DataFrame,
    most: tuple[int, int] = (ORDINARY_DOCUMENTS, TOXIC_DOCUMENTS),
) -> tuple[pa.Array, list[int], float]:
    """Texts and labels of the sample, and the share of toxic labels.

    Labels with a null count as none; of several labels of a document the highest
    counts. Documents of fold 0, and those with a null id, are never taken.
    """
    known = (
        labels.filter(remainder("doc_id", FOLDS) != 0)
        .filter(F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return pa.array([], pa.string()), [], 0.5
    grain = 1_000_000
    share = {k: min(grain, int(grain * most[k] / n) + 1) for k, n in counts.items()}
    sample = known.filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(grain))
        < F.when(F.col("toxic") == 1, share.get(1, 0)).otherwise(share.get(0, 0))
    )
    # the sample's size is bounded by ``most``
    rows = (
        documents.select("doc_id", "text")
        .filter(F.length("text").between(1, DOCUMENT_CHARS))
        .join(F.broadcast(sample), "doc_id")
        .select("text", "toxic", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("order"))
        .toArrow()
        .sort_by([("order", "ascending"), ("text", "ascending")])
    )
    share_toxic = counts.get(1, 0) / sum(counts.values())
    return rows["text"].combine_chunks(), rows["toxic"].to_pylist(), share_toxic


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``documents``.

    A null text scores as an empty one. A null id gives a null held_out.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model.scores(batch["text"])
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["held_out"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )

    ready = documents.select(
        F.col("doc_id").cast("bigint"),
        (remainder("doc_id", FOLDS) == 0).alias("held_out"),
        F.col("text").cast("string"),
    )
    return arrow_map(ready, rows, "doc_id bigint, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document, learned from ``labels`` outside fold 0."""
    documents = read_table(spark, folder, "documents")
    return score(documents, learn(*training_texts(documents, read_table(spark, folder, "labels"))))
