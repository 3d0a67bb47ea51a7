"""Packing: concatenate and cut, by two-pass prefix sums.

The first pass turns each document into token ids and notes where it starts among
the tokens of its task. The tasks' totals, one row each, are added up to global
offsets. The second pass cuts the one long stream into windows of a fixed length;
a document that crosses a border gets a record on each side of it.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import stored
from ledgerline.sources import read_table

LENGTH = 1024
END = 0
#: Files of the vocabulary: its ranks, and its tokenizer with the added tokens.
RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file, which are matched in texts as they stand."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    for token in added:
        if any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {token['content']!r} is not matched as it stands")
    return {token["content"]: token["id"] for token in added}


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level BPE of a rank file, with the added tokens of TOKENIZER.

    Its ids, with all added tokens allowed, are those of ``tokenizers`` on TOKENIZER:
    texts are split at the added tokens first.
    """
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "byte_bpe",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=ranks,
        special_tokens=added_tokens(public_tokenizers.path(TOKENIZER)),
    )


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a tokenizer file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(path))


def ids_of(text: str, path: str) -> np.ndarray:
    """The ids of a text, of any length and whatever it repeats.

    The expression that ``encoding`` splits texts with gives up on runs of some 650,000
    blanks. Such a text is encoded by ``tokenizers`` itself, several times slower.
    """
    try:
        return encoding(path).encode_to_numpy(text, allowed_special="all").astype("<u4")
    except ValueError:
        own = tokenizer(public_tokenizers.path(TOKENIZER))
        return np.array(own.encode(text, add_special_tokens=False).ids, "<u4")


def _token_ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [
                np.append(ids_of(t or "", path), np.uint32(END)).astype("<u4") for t in batch["text"].to_pylist()
            ]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), task, np.int32)),
                    batch["doc_id"],
                    pa.array(starts),
                    pa.array(sizes),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                ],
                ["task", "doc_id", "start", "tokens", "ids"],
            )

    return run


def token_ids(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """task, doc_id, start in the task, tokens and ids (4 bytes each, least first).

    Each row of ``documents`` gives one row; a null text counts as an empty one
    and has the end token alone. The rows are written to the shared folder once,
    so that a task that runs again later cannot change what another one counted.
    """
    path = vocabulary or public_tokenizers.path(RANKS)
    made = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _token_ids(path), "task int, doc_id bigint, start bigint, tokens bigint, ids binary"
    )
    return stored(made, "tokens")


def cut(ids: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces of the stream that the documents of ``token_ids`` form.

    Sequence k holds the tokens from k * length on. All sequences are full but
    the last one.
    """
    totals = ids.groupBy("task").agg(F.sum("tokens").alias("total"))
    # one row for each task of the first pass, so its size is that of the task list
    before = totals.select(
        F.col("task").alias("of_task"),
        (F.sum("total").over(Window.orderBy("task")) - F.col("total")).alias("base"),
    )
    piece = (
        lambda k: F.struct(
            (F.greatest(k * length, F.col("first")) - F.col("first")).alias("start"),
            (
                F.least((k + 1) * length, F.col("first") + F.col("tokens"))
                - F.greatest(k * length, F.col("first"))
            ).alias("length"),
            k.alias("sequence_id"),
            (F.greatest(k * length, F.col("first")) - k * length).alias("offset"),
        )
    )
    crc = lambda p: F.crc32(
        F.substring(F.col("ids"), (4 * p["start"] + 1).cast("int"), (4 * p["length"]).cast("int"))
    )
    return (
        ids.join(F.broadcast(before), F.col("task") == F.col("of_task"))
        .withColumn("first", F.col("base") + F.col("start"))
        .select(
            "doc_id",
            F.col("tokens").alias("doc_tokens"),
            F.transform(
                F.transform(
                    F.sequence(
                        F.expr(f"first div {length}"), F.expr(f"(first + tokens - 1) div {length}")
                    ),
                    piece,
                ),
                lambda p: F.struct(p.alias("p"), crc(p).alias("crc")),
            ).alias("pieces"),
        )
        .select("doc_id", "doc_tokens", F.explode("pieces").alias("x"))
        .select(
            "doc_id",
            F.col("x.p.start").alias("start"),
            F.col("x.p.length").alias("length"),
            F.col("x.crc").alias("ids_crc32"),
            "doc_tokens",
            F.col("x.p.sequence_id").alias("sequence_id"),
            F.col("x.p.offset").alias("offset"),
        )
    )


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all ``documents`` in sequences of 1,024 tokens."""
    return cut(token_ids(read_table(spark, folder, "documents")))
