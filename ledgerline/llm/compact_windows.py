"""Substring dedup: near-duplicate passages by compact windows.

A passage is PASSAGE words in a row, taken as the set of its shingles. Two passages of
different documents are near duplicates when their sets are PERCENT alike. For one
hash of the shingles, the passages of a text fall into runs that share their least
hash: these are the compact windows, the nodes of the Cartesian tree over the hashes
that are at least a passage wide. The runs are read off the minima of all passages,
which are made block by block for the whole batch, not node by node.

1. Texts that are the same are searched as one.
2. A band has two hashes. Where a compact window of one meets one of the other, the
   passages share both least shingles; the interval gets one row, with the place of
   the first hash's least shingle, in a cell named by the two.
3. In each cell that several texts share, every row is paired with the least one, and
   further rows of the least text with the greatest one. The rows of a text are put together, so that it is cut once, and the
   other side is cut into blocks, so that a long text goes nowhere as a whole.
4. Passages around the two places are compared exactly.
5. A row whose place is in no hit with its centre is compared with all rows of other
   texts in its cell. The rows left out hang together by the centre. In a cell with
   many rows, only those are compared that share one of the rarest shingles of a
   passage each: alike ones do (a prefix filter), so no hit is lost. A short phrase
   that many texts share thus costs no comparison of all its rows; what still grows
   with a square are rows whose passages are almost alike.

Two passages of the least similarity share a cell of a band with a probability of
0.64, and one of the three bands with 0.95; passages that repeat exactly always do.
Where a row's place is in a hit, passages of its interval beyond the hit are not
compared with others. ``tests/llm`` measures the recall against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import stored, text_of, words_of
from ledgerline.llm.components import components
from ledgerline.llm.word_hashes import hashed_words, inside, mixed, parts, shingles
from ledgerline.sources import read_table

PASSAGE = 50
SHINGLE = 5
#: Shingles of a passage.
WIDTH = PASSAGE - SHINGLE + 1
PERCENT = 80
BANDS = 3
#: Passages of a block of the other side.
BLOCK = 1024
#: Pairs of runs of shingles that are taken up at a time.
COMPARED = 2000
#: A cell with so many rows goes by the rare shingles of their passages.
CROWD = 100
#: Shingles in more rows of such a cell are put in order by how many, the others come before them.
OFTEN = 10

_ODD = np.uint64(0x9E3779B97F4A7C15)


def least_of_all(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, 2**64 - 1, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def windows(words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each band: text, cell and place (from the text's start) of each interval."""
    whole, _ = inside(offsets, PASSAGE, len(words))
    n = len(whole)
    if not whole.any():
        return
    hashes = shingles(words, SHINGLE)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    for band in range(BANDS):
        first, second = (mixed(hashes ^ mixed(np.full(1, np.uint64(2 * band + k + 1)))) for k in (0, 1))
        low, other = least_of_all(first, WIDTH), least_of_all(second, WIDTH)
        new = np.ones(n, bool)
        new[1:] = (low[1:] != low[:-1]) | (other[1:] != other[:-1]) | (text[1:] != text[:-1])
        start = np.flatnonzero(new & whole)
        place = np.empty(len(start), np.int64)
        for a in range(0, len(start), 50_000):
            part = start[a : a + 50_000]
            same = first[part[:, None] + np.arange(WIDTH)] == low[part][:, None]
            place[a : a + 50_000] = part + same.argmax(1)
        cell = mixed(low[start] * _ODD + other[start] + np.uint64(band))
        yield text[start], cell, place - offsets[text[start]]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 8_000_000):
        offsets, words = hashed_words(batch["text"])
        for text, cell, place in windows(words, offsets):
            yield pa.RecordBatch.from_arrays(
                [
                    batch["node"].take(pa.array(text)),
                    pa.array(cell.view(np.int64)),
                    pa.array(place.astype(np.int32)),
                ],
                ["node", "cell", "place"],
            )


def _text_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batches in parts, with the shingles of each text; many texts are hashed at once."""
    for batch in parts(batches, 4_000_000):
        offsets, words = hashed_words(batch["text"])
        hashes = shingles(words, SHINGLE)
        ends = np.maximum(offsets[1:] - SHINGLE + 1, offsets[:-1])
        yield batch, [hashes[a:b] for a, b in zip(offsets[:-1].tolist(), ends.tolist(), strict=True)]


_SLICE = "node bigint, centre bigint, block int, first int, shift int, shingles binary"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is to be compared of each text, by centre and block of the centre.

    ``first`` is the first passage, ``shift`` leads to its place in the centre.
    """
    for batch, held in _text_shingles(batches):
        for i, own in enumerate(held):
            wanted = batch["wanted"][i].values
            centre, place, other = (wanted.field(k).to_numpy().astype(np.int64) for k in range(3))
            shift = other - place
            order = np.lexsort((place, shift, centre))
            centre, place, shift = centre[order], place[order], shift[order]
            low = np.maximum(np.maximum(place - WIDTH + 1, 0), -shift)
            high = np.minimum(place, len(own) - WIDTH) + 1
            new = np.ones(len(order), bool)
            new[1:] = (
                (centre[1:] != centre[:-1]) | (shift[1:] != shift[:-1]) | (low[1:] > high[:-1])
            )
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(order)) - 1
            rows = []
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                a, b, move = int(low[s]), int(high[e]), int(shift[s])
                while a < b:
                    block = (a + move) // BLOCK
                    to = min(b, (block + 1) * BLOCK - move)
                    rows.append((int(centre[s]), block, a, move, own[a : to + WIDTH - 1].tobytes()))
                    a = to
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["node"][i].as_py()] * len(rows), pa.int64()),
                        *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)),
                    ],
                    ["node", "centre", "block", "first", "shift", "shingles"],
                )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks wanted of each text."""
    for batch, held in _text_shingles(batches):
        for i, own in enumerate(held):
            wanted = batch["wanted"][i].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch["node"][i].as_py()] * len(wanted), pa.int64()),
                    pa.array(wanted, pa.int32()),
                    pa.array(
                        [own[b * BLOCK : (b + 1) * BLOCK + WIDTH - 1].tobytes() for b in wanted], pa.binary()
                    ),
                ],
                ["centre", "block", "theirs"],
            )


def alike(own: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """For each passage of ``own`` whether the one at the same place of ``theirs`` is near."""
    size = min(len(own), len(theirs))
    n = size - WIDTH + 1
    if n <= 0:
        return np.zeros(0, bool)
    own, theirs = own[:size], theirs[:size]
    order = np.argsort(theirs, kind="stable")
    ordered = theirs[order]
    if len(np.unique(own)) < size or (ordered[1:] == ordered[:-1]).any():
        # shingles that repeat: each passage is compared as a set
        out = np.zeros(n, bool)
        a, b = own.tolist(), theirs.tolist()
        for i in range(n):
            x, y = set(a[i : i + WIDTH]), set(b[i : i + WIDTH])
            both = len(x & y)
            out[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
        return out
    found = np.minimum(np.searchsorted(ordered, own), size - 1)
    here = np.flatnonzero(ordered[found] == own)
    if 100 * len(here) < PERCENT * (2 * WIDTH - len(here)):
        return np.zeros(n, bool)  # too few common shingles for any passage
    there = order[found[here]]
    # a common shingle counts for the passages that hold it on both sides
    low = np.maximum(np.maximum(here, there) - WIDTH + 1, 0)
    high = np.minimum(np.minimum(here, there), n - 1) + 1
    fits = high > low
    step = np.bincount(low[fits], minlength=n + 1) - np.bincount(high[fits], minlength=n + 1)
    both = np.cumsum(step)[:n]
    return 100 * both >= PERCENT * (2 * WIDTH - both)


def _spread(rows: list[np.ndarray], sizes: np.ndarray, pad: int) -> np.ndarray:
    """Rows side by side, filled up with values that differ from each other and those of another ``pad``."""
    width = int(sizes.max())
    out = np.broadcast_to(np.arange(width, dtype=np.uint64) * np.uint64(2) + np.uint64(pad), (len(rows), width)).copy()
    out[np.arange(width) < sizes[:, None]] = np.concatenate(rows)
    return out


def _alike_rows(own: list[np.ndarray], theirs: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """``alike`` of each of many pairs of the same ``sizes``, a row each; no passage ends beyond the size."""
    count, width = len(own), int(sizes.max())
    both = np.concatenate([_spread(own, sizes, 0), _spread(theirs, sizes, 1)], axis=1)
    order = np.argsort(both, axis=1, kind="stable")
    ordered = np.take_along_axis(both, order, 1)
    row, at = np.nonzero(ordered[:, 1:] == ordered[:, :-1])
    here, there = order[row, at], order[row, at + 1] - width
    # a shingle that repeats on one side: the row is compared by itself
    odd = np.zeros(count, bool)
    odd[row[(here >= width) | (there < 0)]] = True
    fits = ~odd[row]
    row, here, there = row[fits], here[fits], there[fits]
    n = width - WIDTH + 1
    # a common shingle counts for the passages that hold it on both sides
    low = np.maximum(np.maximum(here, there) - WIDTH + 1, 0)
    high = np.minimum(np.minimum(here, there), n - 1) + 1
    fits = high > low
    row, low, high = row[fits] * (n + 1), low[fits], high[fits]
    step = np.bincount(row + low, minlength=count * (n + 1)) - np.bincount(row + high, minlength=count * (n + 1))
    held = np.cumsum(step.reshape(count, n + 1), axis=1)[:, :n]
    near = (100 * held >= PERCENT * (2 * WIDTH - held)) & (np.arange(n) < sizes[:, None] - WIDTH + 1)
    for i in np.flatnonzero(odd):
        near[i] = False
        near[i, : sizes[i] - WIDTH + 1] = alike(own[i], theirs[i])
    return near


def near_runs(own: list[np.ndarray], theirs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, first and last passage (exclusive) of each run of passages that are ``alike``.

    Pairs of about the same size are worked on many at a time.
    """
    sizes = np.fromiter((min(len(x), len(y)) for x, y in zip(own, theirs, strict=True)), np.int64, len(own))
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] >= WIDTH]
    found = [np.zeros((3, 0), np.int64)]
    while len(order):
        # sizes that differ by an eighth at most, and some cells in all
        least = sizes[order[0]]
        some = min(int(np.searchsorted(sizes[order], least + least // 8, "right")), max(1, 300_000 // int(least)))
        part, order = order[:some], order[some:]
        size = sizes[part]
        cut = [[side[i][:n] for i, n in zip(part.tolist(), size.tolist(), strict=True)] for side in (own, theirs)]
        near = _alike_rows(*cut, size).astype(np.int8)
        edges = np.diff(near, axis=1, prepend=0, append=0)
        row, first = np.nonzero(edges == 1)
        found.append(np.stack([part[row], first, np.nonzero(edges == -1)[1]]))
    return tuple(np.concatenate(found, axis=1))


def _told(node: np.ndarray, partner: np.ndarray, spans: tuple, others: tuple) -> pa.RecordBatch:
    """Each hit from both sides."""
    columns = (
        np.concatenate([node, partner]), np.concatenate([partner, node]),
        *(np.concatenate(x).astype(np.int32) for x in zip(spans, others, strict=True)),
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "partner", "first", "last"])


def _shingles_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, COMPARED):
            batch = whole.slice(at, COMPARED)
            node, centre, block, first, shift = (
                batch[k].to_numpy().astype(np.int64) for k in ("node", "centre", "block", "first", "shift")
            )
            theirs = _shingles_of(batch["theirs"])
            begins = (first + shift - block * BLOCK).tolist()
            i, a, b = near_runs(_shingles_of(batch["shingles"]), [t[k:] for t, k in zip(theirs, begins, strict=True)])
            a, b, shift = first[i] + a, first[i] + b - 1 + PASSAGE, shift[i]
            if len(i):
                yield _told(node[i], centre[i], (a, b), (a + shift, b + shift))


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """node, partner and the run of words (first, last) of each near duplicate of a pair.

    ``pairs`` has node, place, centre and centre_place. Each hit is told from both sides.
    """
    wanted = pairs.groupBy("node").agg(
        F.collect_list(F.struct("centre", "place", "centre_place")).alias("wanted")
    )
    slices = stored(texts.join(wanted, "node").select("node", "wanted", "text").mapInArrow(_slices, _SLICE), "windows-slices")
    asked = (
        slices.select("centre", "block").distinct()
        .groupBy(F.col("centre").alias("node")).agg(F.collect_list("block").alias("wanted"))
    )
    blocks = texts.join(asked, "node").select("node", "wanted", "text").mapInArrow(
        _blocks, "centre bigint, block int, theirs binary"
    )
    return slices.join(blocks, ["centre", "block"]).mapInArrow(
        _compare, "node bigint, partner bigint, first int, last int"
    )


def _paired(rows: DataFrame) -> DataFrame:
    """The rows of cells that several texts share, each with the row it is compared with.

    That is the cell's least one; for further rows of the least text it is the greatest
    one. The least row itself is the other side of those, and has a null centre.
    """
    row, cell = F.struct("node", "place"), Window.partitionBy("cell")
    other = F.when(F.col("node") != F.col("least.node"), F.col("least")).when(
        F.col("place") != F.col("least.place"), F.col("greatest")
    )
    # one shuffle of all rows: most cells have one, so it is not worth looking for the others first
    return (
        rows.withColumn("least", F.min(row).over(cell))
        .withColumn("greatest", F.max(row).over(cell))
        .filter("greatest.node > least.node")
        .withColumn("other", other)
        .select(
            "node", "cell", "place",
            F.col("other.node").alias("centre"), F.col("other.place").alias("centre_place"),
        )
    )


def _marked(shared: DataFrame, found: DataFrame) -> DataFrame:
    """node, cell and place of ``shared``, and whether it is open: in no hit with its centre."""
    part = lambda k: F.floor(F.col(k) / BLOCK).cast("int")
    hits = found.select(
        "node",
        F.col("partner").alias("centre"),
        "first",
        "last",
        F.explode(F.sequence(part("first"), F.floor((F.col("last") - 1) / BLOCK).cast("int"))).alias("part"),
    )
    closed = (
        shared.withColumn("part", part("place")).join(hits, ["node", "centre", "part"])
        .filter("first <= place AND place < last").select("node", "cell", "place").distinct()
        .withColumn("open", F.lit(False))
    )
    return shared.select("node", "cell", "place").join(closed, ["node", "cell", "place"], "left").withColumn(
        "open", F.coalesce("open", F.lit(True))
    )


_AROUND = "node bigint, cell bigint, place int, open boolean, crowded boolean, back int, around binary"


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of all passages that hold a place, for each row wanted of each text."""
    for batch, held in _text_shingles(batches):
        for i, own in enumerate(held):
            everything = batch["wanted"][i].values
            for a in range(0, len(everything), 10_000):
                wanted = everything.slice(a, 10_000)
                places = wanted.field(1).to_pylist()
                lows = [max(p - WIDTH + 1, 0) for p in places]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch["node"][i].as_py()] * len(places), pa.int64()),
                        *(wanted.field(k) for k in range(4)),
                        pa.array([p - low for p, low in zip(places, lows, strict=True)], pa.int32()),
                        pa.array([own[low : p + WIDTH].tobytes() for p, low in zip(places, lows, strict=True)], pa.binary()),
                    ],
                    ["node", "cell", "place", "open", "crowded", "back", "around"],
                )


def _compare_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, COMPARED):
            batch = whole.slice(at, COMPARED)
            node, place, back, partner, other, other_back = (
                batch[k].to_numpy().astype(np.int64)
                for k in ("node", "place", "back", "partner", "partner_place", "partner_back")
            )
            both = np.minimum(back, other_back)
            own, theirs = (
                [x[k:] for x, k in zip(_shingles_of(batch[c]), skipped.tolist(), strict=True)]
                for c, skipped in (("around", back - both), ("partner_around", other_back - both))
            )
            i, a, b = near_runs(own, theirs)
            a, b = a - both[i], b - both[i] - 1 + PASSAGE
            if len(i):
                yield _told(node[i], partner[i], (place[i] + a, place[i] + b), (other[i] + a, other[i] + b))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle around a place, numbered."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            rows = batch.slice(a, 1000)
            around = [np.frombuffer(x.as_buffer(), np.int64) for x in rows["around"]]
            sizes = np.fromiter(map(len, around), np.int64, len(around))
            each = pa.array(np.repeat(np.arange(len(around)), sizes))
            at = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            names = ["node", "cell", "place", "open"]
            yield pa.RecordBatch.from_arrays(
                [*(rows[k].take(each) for k in names), pa.array(at.astype(np.int32)), pa.array(np.concatenate(around))],
                [*names, "at", "shingle"],
            )


def rarest(own: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles of which each passage of ``own`` needs one in any passage it is alike.

    ``often`` tells for each place of ``own`` how often its shingle occurs, the same for all rows
    that are compared. Of n different shingles, alike passages share PERCENT of a hundred
    at least, so among any order of all shingles they share one of the first of each.
    """
    if len(own) < WIDTH:
        return own[:0]
    different, first, code = np.unique(own, return_index=True, return_inverse=True)
    order = np.lexsort((different, often[first]))
    rank = np.argsort(order)[code]
    passages = np.lib.stride_tricks.sliding_window_view(rank, WIDTH)
    needed = lambda n: n - -(-PERCENT * n // 100) + 1
    if len(different) == len(own):
        k = needed(WIDTH)
        chosen = np.unique(np.partition(passages, k - 1, axis=1)[:, :k])
    else:
        sets = [np.unique(p) for p in passages]
        chosen = np.unique(np.concatenate([p[: needed(len(p))] for p in sets]))
    return different[order[chosen]]


def _rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = batch["held"].offsets.to_numpy()
        at, shingle, often = (batch["held"].values.field(k).to_numpy() for k in range(3))
        found = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            order = a + np.argsort(at[a:b])
            found.append(rarest(shingle[order], often[order]))
        each = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        names = ["node", "cell", "place", "open"]
        yield pa.RecordBatch.from_arrays(
            [*(batch[k].take(each) for k in names), pa.array(np.concatenate(found))], [*names, "shingle"]
        )


#: Two open rows meet once.
_MEET = "node < partner OR (node > partner AND NOT partner_open)"


def _crowded(around: DataFrame) -> DataFrame:
    """Both nodes and places of the rows to compare, of all rows of these cells."""
    rows = "node bigint, cell bigint, place int, open boolean"
    each = around.mapInArrow(_shingled, f"{rows}, at int, shingle bigint")
    often = stored(
        each.groupBy("cell", "shingle").agg(F.count("*").alias("often")).filter(F.col("often") > OFTEN), "windows-often"
    )
    held = F.struct("at", "shingle", F.coalesce("often", F.lit(0)).cast("bigint").alias("often"))
    rare = stored(
        each.join(often, ["cell", "shingle"], "left")
        .groupBy("node", "cell", "place", "open")
        .agg(F.collect_set(held).alias("held"))
        .mapInArrow(_rare, f"{rows}, shingle bigint"),
        "windows-rare",
    )
    others = rare.select(
        "cell", "shingle",
        F.col("node").alias("partner"), F.col("place").alias("partner_place"), F.col("open").alias("partner_open"),
    )
    met = rare.filter("open").join(others, ["cell", "shingle"]).filter(_MEET)
    return met.select("node", "place", "partner", "partner_place").distinct()


def _rest_compared(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """The hits of every open row of ``marked`` with all rows of other texts in its cell.

    Rows that are not open hang together by their centre.
    """
    cells = (
        marked.groupBy("cell")
        .agg(F.max("open").alias("any"), F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("held"))
        .filter("any AND most > least")
        .select("cell", (F.col("held") >= CROWD).alias("crowded"))
    )
    wanted = marked.join(cells, "cell").groupBy("node").agg(
        F.collect_list(F.struct("cell", "place", "open", "crowded")).alias("wanted")
    )
    around = stored(texts.join(wanted, "node").select("node", "wanted", "text").mapInArrow(_surroundings, _AROUND), "windows-around")
    few, many = around.filter("NOT crowded"), around.filter("crowded")
    others = lambda rows: rows.select(
        "cell",
        F.col("node").alias("partner"),
        F.col("place").alias("partner_place"),
        F.col("open").alias("partner_open"),
        F.col("back").alias("partner_back"),
        F.col("around").alias("partner_around"),
    )
    columns = ["node", "place", "back", "around", "partner", "partner_place", "partner_back", "partner_around"]
    pairs = few.filter("open").join(others(few), "cell").filter(_MEET).select(columns)
    met = _crowded(many).select(
        "node", "place", F.col("partner").alias("centre"), F.col("partner_place").alias("centre_place")
    )
    found = pairs.mapInArrow(_compare_around, "node bigint, partner bigint, first int, last int")
    # texts that meet in many cells of one passage are compared once there
    return found.union(_compared(met, texts)).distinct()


def passages(texts: DataFrame) -> DataFrame:
    """node, partner, first and last of the near duplicates among different ``texts``.

    ``texts`` has node, one row each, and text.
    """
    rows = texts.select("node", "text").mapInArrow(_cells, "node bigint, cell bigint, place int")
    shared = stored(_paired(rows).filter("centre IS NOT NULL"), "windows-shared")
    found = stored(_compared(shared, texts), "windows-hits")
    return found.union(stored(_rest_compared(_marked(shared, found), texts), "windows-hits"))


def _merged(spans: Column) -> Column:
    """Spans (first, last), joined where they touch, in order."""
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["first"] <= F.element_at(acc, -1)["last"]),
        F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(
                F.struct(
                    F.element_at(acc, -1)["first"].alias("first"),
                    F.greatest(F.element_at(acc, -1)["last"], s["last"]).alias("last"),
                )
            ),
        ),
    ).otherwise(F.concat(acc, F.array(s)))
    none = F.array().cast("array<struct<first:int,last:int>>")
    return F.aggregate(F.sort_array(spans), none, step)


def repeats(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, n_words, n_repeat_words and spans of each row of ``documents``.

    ``spans`` are the runs of words (first, last, counted from 0, last exclusive) that
    are near a passage of another document, and class_id is the least doc_id that
    such passages lead to, the row's own included. A text given under two ids is all
    one passage if it has PASSAGE words. A null or empty text, or a shorter one, has
    no passages. Rows given twice are one document, as are rows that share an id, of
    which one text is searched. Rows without an id are not searched, and have a null
    class_id.
    """
    text = text_of()
    ready = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    each = stored(
        ready.select(
            "doc_id",
            F.xxhash64(text).alias("k1"),
            F.xxhash64(F.lit(1), text).alias("k2"),
            F.size(words_of(text)).alias("n_words"),
        ),
        "windows-keys",
    )
    classes = stored(
        each.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= PASSAGE))
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("node"), (F.max("doc_id") > F.min("doc_id")).alias("copied")),
        "windows-classes",
    )
    texts = stored(
        ready.join(classes.select("node").distinct(), F.col("doc_id") == F.col("node"))
        .dropDuplicates(["node"])
        .select("node", "text"),
        "windows-texts",
    )
    found = passages(texts)
    labels = components(found.select(F.col("node").alias("a"), F.col("partner").alias("b")))
    spans = found.select("node", "first", "last").distinct().groupBy("node").agg(
        _merged(F.collect_list(F.struct("first", "last"))).alias("near")
    )
    told = classes.join(labels, "node", "left").join(spans, "node", "left").select(
        "k1", "k2", "copied", F.coalesce("component", "node").alias("component"), "near"
    )
    none = F.array().cast("array<struct<first:int,last:int>>")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").alias("last")))
    return (
        each.join(told, ["k1", "k2"], "left")
        .withColumn(
            "spans",
            F.when(F.col("doc_id").isNull(), none).when(F.col("copied"), whole).otherwise(F.coalesce("near", none)),
        )
        .select(
            "doc_id",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("class_id"),
            F.col("n_words").cast("bigint").alias("n_words"),
            F.aggregate("spans", F.lit(0), lambda t, s: t + s["last"] - s["first"]).cast("bigint").alias("n_repeat_words"),
            "spans",
        )
    )


def op5_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate passages of all ``documents``; spans as first:last, comma-joined."""
    return repeats(read_table(spark, folder, "documents")).withColumn(
        "spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"], s["last"])), ",")
    )
