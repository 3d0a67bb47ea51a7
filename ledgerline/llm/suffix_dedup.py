"""Suffix-array dedup: repeated byte strings, by deep-shallow sorting.

A byte goes if a string of SPAN bytes that covers it also starts elsewhere. Not every
suffix need be sorted to know: of the seeds (strings of SEED bytes) in any SPAN
bytes, the one with the least hash is the same wherever these bytes occur. The
places of such seeds are anchors, about one in a hundred bytes, and whatever is
repeated is repeated around an anchor, with the same seed.

Around an anchor, L bytes to the left and R bytes to the right (seed included) can
agree with another place of the seed. The string that starts r before the anchor is
repeated if for some other place L >= r and R >= SPAN - r. All repeated strings around
an anchor hold the anchor, so what they cover is one run of bytes.

1. Anchors with the same bytes around them are put together, first in each task.
2. A seed that occurs once is done with; one with a single context too.
3. For the seeds with different contexts, the suffixes right of the seed, and the
   reversed ones left of it, are sorted deep-shallow: by multikey quicksort to a
   shallow depth, then by blind tries for those that agree so far. Common prefixes of
   neighbours in the sorted order tell which suffixes agree to any depth, and pairs
   of them which strings are repeated.
4. The runs go back to the texts, which are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import stored
from ledgerline.llm.word_hashes import mixed, parts
from ledgerline.sources import read_table

SPAN = 400
SEED = 128
SIDE = SPAN - SEED
#: Depth of the multikey quicksort.
SHALLOW = 4
#: Contexts of one seed that a task sorts at most; a seed with more goes by the hashes
#: of its strings, which need not be in one place.
SEED_CONTEXTS = 100_000
#: Contexts that a task works on at once, about.
AT_ONCE = 40_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 20


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, made once in a process."""

    up = down = None

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None or len(cls.up) < n:
            size = max(n, _BLOCK)
            cls.up = np.cumprod(np.append(np.uint64(1), np.full(size, np.uint64(_BASE))))
            cls.down = np.cumprod(np.append(np.uint64(1), np.full(size, np.uint64(_INVERSE))))
        return cls.up[:n], cls.down[:n]


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every string of ``width`` bytes."""
    up, down = _Powers.get(len(data))
    running = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up))
    n = len(data) - width + 1
    return mixed((running[width:] - running[:-width]) * down[:n])


def _sliding(values: np.ndarray, width: int, extreme: np.ufunc, fill: int) -> np.ndarray:
    """The extreme of every ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, fill, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = extreme.accumulate(rows, 1).ravel()
    back = extreme.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return extreme(back[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the seeds that are least in some SPAN bytes, ties included.

    A long text is read in pieces that overlap by SPAN - 1 bytes, so that each string
    lies in one.
    """
    places, hashes = [], []
    width = SIDE + 1
    for start in range(0, max(len(text) - SPAN + 1, 0), _BLOCK):
        piece = np.frombuffer(text, np.uint8, min(len(text), start + _BLOCK + SPAN - 1) - start, start)
        seeds = _rolling(piece, SEED)
        least = _sliding(seeds, width, np.minimum, 2**64 - 1)
        edge = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero(
            seeds == _sliding(np.concatenate([edge, least, edge]), width, np.maximum, 0)
        )
        places.append(chosen + start)
        hashes.append(seeds[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def _side_hash(side: bytes) -> int:
    return xxhash.xxh3_64_intdigest(side, len(side) + 1) - 2**63


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each context in a part of a batch, with the places that have it."""
    for batch in parts(batches, 8_000_000):
        rows: dict[tuple[int, int, int], list] = {}
        for value in batch["text"]:
            text = value.as_py()
            text = text.encode() if text else b""
            if len(text) < SPAN:
                continue
            key = _key(text)
            for place, seed in zip(*(x.tolist() for x in anchors(text)), strict=True):
                left = text[max(0, place - SIDE) : place]
                right = text[place + SEED : place + SPAN]
                name = (seed - 2**63, _side_hash(left), _side_hash(right))
                row = rows.get(name)
                if row is None:
                    rows[name] = row = [len(left), len(right), []]
                row[2].append((key, len(text), place))
        if not rows:
            continue
        seeds, lefts, rights = zip(*rows, strict=True)
        values = list(rows.values())
        members = [m for v in values for m in v[2]]
        counts = np.fromiter((len(v[2]) for v in values), np.int64, len(values))
        keys, sizes, places = (np.array(x, np.int64) for x in zip(*members, strict=True))
        kind = np.dtype([("key", "<i8"), ("size", "<i8"), ("place", "<i8")])
        packed = np.empty(len(keys), kind)
        packed["key"], packed["size"], packed["place"] = keys, sizes, places
        ends = np.append(0, np.cumsum(counts))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(seeds, pa.int64()),
                pa.array(lefts, pa.int64()),
                pa.array(rights, pa.int64()),
                pa.array([v[0] for v in values], pa.int32()),
                pa.array([v[1] for v in values], pa.int32()),
                pa.array(counts),
                pa.array(keys[ends[:-1]]),
                pa.array(sizes[ends[:-1]]),
                pa.array(places[ends[:-1]]),
                pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(keys), pa.array(sizes), pa.array(places)], ["key", "size", "place"]
                    ),
                ),
            ],
            ["seed", "left", "right", "n_left", "n_right", "m", "key", "size", "place", "members"],
        )


# ---- deep-shallow sorting -------------------------------------------------------------


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


def _blind_trie(strings: list[bytes], group: list[int]) -> list[int]:
    """The group in order, by a trie whose nodes keep only where their strings first differ.

    A string goes down by the bytes at these places alone, is compared once with the
    leaf it gets to, and branches off where the two differ.
    """
    root: int | list = group[0]
    for i in group[1:]:
        s, node = strings[i], root
        while not isinstance(node, int):
            node = node[1].get(_byte(s, node[0])) if _byte(s, node[0]) in node[1] else next(
                iter(node[1].values())
            )
        other = strings[node]
        depth = _common(s, other)
        parent, node = None, root
        while not isinstance(node, int) and node[0] < depth:
            parent, node = node, node[1][_byte(s, node[0])]
        if not isinstance(node, int) and node[0] == depth:
            node[1][_byte(s, depth)] = i
            continue
        made = [depth, {_byte(s, depth): i, _byte(other, depth): node}]
        if parent is None:
            root = made
        else:
            parent[1][_byte(s, parent[0])] = made
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
    return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """The order of different strings: multikey quicksort to SHALLOW bytes, then blind tries."""
    out: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) < 2:
            out.extend(group)
        elif depth >= SHALLOW:
            out.extend(_blind_trie(strings, group))
        else:
            pivot = _byte(strings[group[len(group) // 2]], depth)
            low, same, high = [], [], []
            for i in group:
                b = _byte(strings[i], depth)
                (same if b == pivot else low if b < pivot else high).append(i)
            # strings that end here are alone, as they differ
            todo.append((high, depth))
            todo.append((same, depth + 1 if pivot >= 0 else SHALLOW))
            todo.append((low, depth))
    return out


def _ranked(groups: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For the strings of all groups: rank overall, and common prefix with the one before.

    Ranks follow the groups; between groups nothing is in common, told by -1.
    """
    rank, shared, base = [], [], 0
    for strings in groups:
        order = deep_shallow(strings)
        place = [0] * len(order)
        before = None
        for at, i in enumerate(order):
            place[i] = base + at
            shared.append(-1 if before is None else _common(strings[before], strings[i]))
            before = i
        rank.extend(place)
        base += len(order)
    return np.array(rank, np.int64), np.array(shared, np.int64)


def repeated(
    lefts: list[list[bytes]], rights: list[list[bytes]], group: np.ndarray, left: np.ndarray, right: np.ndarray, m: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For each context the bytes left of the anchor, and right from it on, that go.

    ``lefts`` (reversed) and ``rights`` are the different sides of each seed; a context is
    the seed's group, the number of its left and right side in it, and its places m.
    (-1, -1) where nothing goes.
    """
    first_l = np.cumsum([0] + [len(g) for g in lefts])[group]
    first_r = np.cumsum([0] + [len(g) for g in rights])[group]
    rank_l, shared_l = _ranked(lefts)
    rank_r, shared_r = _ranked(rights)
    size_l = np.array([len(s) for g in lefts for s in g], np.int64)[first_l + left]
    size_r = np.array([len(s) for g in rights for s in g], np.int64)[first_r + right]
    at_l, at_r = rank_l[first_l + left], rank_r[first_r + right]
    most, least = np.full(len(m), -1), np.full(len(m), SPAN + 1)
    for r in range(SIDE + 1):
        fits = np.flatnonzero((size_l >= r) & (size_r >= SIDE - r))
        if not len(fits):
            continue
        # sides that agree to the depth stand together in the order, in one class
        class_l = np.cumsum(shared_l < r)[at_l[fits]]
        class_r = np.cumsum(shared_r < SIDE - r)[at_r[fits]]
        pair = class_l * (len(shared_r) + 1) + class_r
        order = np.argsort(pair, kind="stable")
        edges = np.flatnonzero(np.diff(pair[order], prepend=-1))
        total = np.add.reduceat(m[fits][order], edges)
        hit = fits[order[np.repeat(total > 1, np.diff(np.append(edges, len(order))))]]
        most[hit] = np.maximum(most[hit], r)
        least[hit] = np.minimum(least[hit], r)
    return most, np.where(most < 0, -1, SPAN - least)


def _sort_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the contexts in a partition that is sorted by seed.

    Rows are contexts (side 0, with m) and sides (1 left, 2 right, with bytes).
    """

    def done(rows: list[dict]) -> pa.RecordBatch:
        seeds: dict[int, int] = {}
        sides: tuple[list, list] = ([], [])
        number: tuple[dict, dict] = ({}, {})
        contexts = []
        for row in rows:
            g = seeds.setdefault(row["seed"], len(seeds))
            if g == len(sides[0]):
                sides[0].append([])
                sides[1].append([])
            if row["side"]:
                k = row["side"] - 1
                number[k][g, row["left"] if k == 0 else row["right"]] = len(sides[k][g])
                sides[k][g].append(row["bytes"][::-1] if k == 0 else row["bytes"])
            else:
                contexts.append((g, row))
        group = np.array([g for g, _ in contexts], np.int64)
        left = np.array([number[0][g, c["left"]] for g, c in contexts], np.int64)
        right = np.array([number[1][g, c["right"]] for g, c in contexts], np.int64)
        m = np.array([c["m"] for _, c in contexts], np.int64)
        back, on = repeated(*sides, group, left, right, m)
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array([c[k] for _, c in contexts], pa.int64()) for k in ("seed", "left", "right")),
                pa.array(back),
                pa.array(on),
            ],
            ["seed", "left", "right", "back", "on"],
        ).filter(pa.array(back >= 0))

    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if len(rows) >= AT_ONCE and row["seed"] != rows[-1]["seed"]:
                yield done(rows)
                rows = []
            rows.append(row)
    if rows:
        yield done(rows)


# ---- the whole ------------------------------------------------------------------------


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        raw = [t.encode() if t else b"" for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                pa.array(map(_key, raw), pa.int64()),
                pa.array(map(len, raw), pa.int64()),
                pa.array(raw, pa.binary()),
            ],
            ["doc_id", "key", "size", "raw"],
        )


_SIDE_ROW = (
    "seed bigint, side int, left bigint, right bigint, m bigint, bytes binary"
)


def _cut_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the sides that a text stands for."""
    for batch in batches:
        out = []
        for raw, wanted in zip(batch["raw"], batch["wanted"].to_pylist(), strict=True):
            text = raw.as_buffer().to_pybytes()
            for w in wanted:
                a = w["place"]
                side = text[max(0, a - SIDE) : a] if w["side"] == 1 else text[a + SEED : a + SPAN]
                out.append((w["seed"], w["side"], w["left"], w["right"], 0, side))
        if out:
            columns = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                ["seed", "side", "left", "right", "m", "bytes"],
            )


def _hash_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each string of SPAN bytes around the anchors wanted of a text."""
    for batch in batches:
        for raw, wanted in zip(batch["raw"], batch["wanted"].to_pylist(), strict=True):
            text, out = raw.as_buffer().to_pybytes(), []
            for w in wanted:
                a = w["place"]
                for r in range(max(0, a + SPAN - len(text)), min(SIDE, a) + 1):
                    digest = xxhash.xxh3_128_digest(text[a - r : a - r + SPAN])
                    out.append((w["seed"], w["left"], w["right"], w["m"], r, digest))
            if out:
                kinds = (pa.int64(),) * 5 + (pa.binary(),)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                    ["seed", "left", "right", "m", "r", "string"],
                )


def _wanted(rows: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    """One copy of each text (raw) with the array of what is wanted of it."""
    asked = rows.groupBy("key", "size").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    return (
        texts.select("key", "size", "raw")
        .join(asked, ["key", "size"])
        .dropDuplicates(["key", "size"])
        .select("raw", "wanted")
    )


def runs(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """key, size and the array of (first, last) bytes that go, of each text with any."""
    found = stored(
        documents.select("text").mapInArrow(
            _anchor_rows,
            "seed bigint, left bigint, right bigint, n_left int, n_right int, m bigint, "
            "key bigint, size bigint, place bigint, "
            "members array<struct<key:bigint,size:bigint,place:bigint>>",
        ),
        "suffix-anchors",
    )
    # stored, so that the join with them can split a common seed
    live = stored(
        found.groupBy("seed").agg(F.sum("m").alias("places")).filter("places > 1").select("seed"), "suffix-seeds"
    )
    kept = stored(found.join(live, "seed"), "suffix-live")
    contexts = stored(
        kept.groupBy("seed", "left", "right").agg(
            F.sum("m").alias("m"),
            F.first("n_left").alias("n_left"),
            F.first("n_right").alias("n_right"),
            F.min(F.struct("key", "size", "place")).alias("at"),
        ),
        "suffix-contexts",
    )
    counts = stored(contexts.groupBy("seed").agg(F.count("*").alias("contexts")), "suffix-counts")
    several = stored(
        contexts.join(counts, "seed").select(
            "seed", "left", "right", "m", "n_left", "n_right", "contexts", "at.key", "at.size", "at.place"
        ),
        "suffix-several",
    )
    # one context, so every string around it is repeated as often as it
    alone = several.filter("contexts = 1").select(
        "seed", "left", "right", F.col("n_left").cast("bigint").alias("back"),
        (SEED + F.col("n_right")).cast("bigint").alias("on"),
    )
    sorted_ = several.filter(F.col("contexts").between(2, SEED_CONTEXTS))
    at = F.min(F.struct("key", "size", "place")).alias("at")
    none = F.lit(None).cast("bigint")
    sides = (
        sorted_.groupBy("seed", "left").agg(at)
        .select("seed", F.lit(1).alias("side"), "left", none.alias("right"), "at.*")
        .union(
            sorted_.groupBy("seed", "right").agg(at)
            .select("seed", F.lit(2).alias("side"), none.alias("left"), "right", "at.*")
        )
    )
    cut = _wanted(sides, texts, ["seed", "side", "left", "right", "place"]).mapInArrow(_cut_sides, _SIDE_ROW)
    rows = cut.union(
        sorted_.select("seed", F.lit(0).alias("side"), "left", "right", "m", F.lit(None).cast("binary").alias("bytes"))
    )
    extents = "seed bigint, left bigint, right bigint, back bigint, on bigint"
    by_sorting = (
        rows.repartition("seed").sortWithinPartitions("seed").mapInArrow(_sort_seeds, extents)
    )
    out = alone.union(by_sorting)
    rest = several.filter(F.col("contexts") > SEED_CONTEXTS)
    if not rest.isEmpty():
        strings = stored(
            _wanted(rest, texts, ["seed", "left", "right", "m", "place"]).mapInArrow(
                _hash_strings, "seed bigint, left bigint, right bigint, m bigint, r bigint, string binary"
            ),
            "suffix-strings",
        )
        twice = strings.groupBy("string", "seed", "r").agg(F.sum("m").alias("places")).filter("places > 1")
        out = out.union(
            strings.join(twice.select("string", "seed", "r"), ["string", "seed", "r"])
            .groupBy("seed", "left", "right")
            .agg(F.max("r").alias("back"), (SPAN - F.min("r")).alias("on"))
        )
    out = stored(out, "suffix-extents")
    return (
        kept.select("seed", "left", "right", "members")
        .join(out, ["seed", "left", "right"])
        .select(F.explode("members").alias("x"), "back", "on")
        .groupBy("x.key", "x.size")
        .agg(
            F.collect_set(
                F.struct((F.col("x.place") - F.col("back")).alias("first"), (F.col("x.place") + F.col("on")).alias("last"))
            ).alias("runs")
        )
    )


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, runs_ in zip(batch["raw"], batch["runs"].to_pylist(), strict=True):
            text = raw.as_buffer().to_pybytes()
            at = removed = spans = 0
            kept, end = [], -1
            for a, b in sorted((r["first"], r["last"]) for r in runs_ or []):
                if a > end:
                    kept.append(text[at:a])
                    spans += 1
                    end, at = b, b
                    removed += b - a
                elif b > end:
                    removed += b - end
                    end = at = b
            kept.append(text[at:])
            left = b"".join(kept)
            out.append((len(text), removed, spans, hashlib.sha256(left).hexdigest(), left))
        n, removed, spans, digest, left = zip(*out, strict=True) if out else ([],) * 5
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.binary()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def cut_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of each row.

    A null text counts as an empty one. Texts under SPAN bytes stay whole. A row given
    twice is two documents, so that each repeats the other. Bytes left of a character
    that was cut through stay as they are.
    """
    ready = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    texts = ready.mapInArrow(_keyed, "doc_id bigint, key bigint, size bigint, raw binary")
    return texts.join(runs(texts, ready), ["key", "size"], "left").select("doc_id", "raw", "runs").mapInArrow(
        _apply,
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary",
    )


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without its repeated strings of 400 bytes.

    ``repeats`` says whether any byte is removed.
    """
    cut = cut_repeats(read_table(spark, folder, "documents")).drop("kept")
    return cut.withColumn("repeats", F.col("n_removed") > 0)
