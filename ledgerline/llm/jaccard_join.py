"""N-gram Jaccard join: count-vector R-tree, with exact links and components.

A document is the set of its word shingles. Hashing deals the shingles into groups, and
its count vector tells how many fall into each of GROUPS groups. The sum of the coordinate
minima of two vectors bounds the overlap of the sets from above, and so does that of the
upper corners of two boxes of vectors. R-trees skip boxes, then vectors, that cannot reach
the overlap a link needs.

The join over many machines goes in these steps, none of which loses a link:

1. Documents with the same set are one class.
2. Two linked sets differ in few shingles. Dealt into more groups than that, they agree in
   some group wholly. So each document goes into a cell for what each of its groups holds:
   a cell has documents that share several shingles, not just one, and a phrase or passage
   that many documents share makes no cells of its own. The number of groups depends on the
   size, in steps of a half; a document whose size is near the next step goes into the
   cells of both. Groups that are empty on both sides tell nothing; a document with so
   many of them that a link could rest on them alone also goes into a cell for each of its
   first shingles, in order of their hashes (the overlap leaves no link without one).
3. Cells are sorted by size and go into blocks of some BLOCK entries, small ones together,
   large ones cut. Each class tries, of the classes that pass the bound with it, the one that
   passes it with the most others (in a large cell, with the most of some JUDGES of them): a
   pair a class. The verified pairs join most of what belongs together, so that of a group of
   near copies few pairs are left to be formed, and no step has compared all of them.
4. In cells that still hold different components, the R-trees of the entries of a cell in a
   block, and in every two blocks, are joined wherever their boxes allow a link, and give all
   pairs across components that pass the bound. The entries of the component with the most
   of a cell meet only the others. No task holds more than two blocks at a time.
5. These pairs are verified too. Verified pairs make the components.

A pair is verified by the overlap of the whole sets. Before the sets meet, their parities
do: for each of some thousand groups of hashes, whether a set has an odd number in it. Two
sets differ in at least as many shingles as their parities differ in groups, so pairs that
differ too much for a link are told from a thirtieth of the bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import drop, fields, left_out, run, sifted, stored
from ledgerline.llm.components import components
from ledgerline.llm.word_hashes import hashed_words, inside, mixed, parts, shingles
from ledgerline.sources import read_table

GROUPS = 256
#: Bytes of texts that are cut into shingles at a time.
TEXTS = 4_000_000
#: Entries of a leaf of the R-tree, and of a block of a cell.
LEAF = 32
BLOCK = 8192
#: Cells of so many entries at most are worked on many at a time.
SMALL = 64
#: Entries of a larger cell that are asked for those that pass the bound with many, and tried of these.
JUDGES = 64
#: Pairs of vectors that are compared at a time.
CHUNK = 4096
#: Groups of the parity of a set: a power of two, from twice its size on, within these.
LEAST_GROUPS, MOST_GROUPS = 64, 2**17
#: Entries of a bucket of cells, about.
BUCKET = 100_000
#: A cell is a hub when over 1 / HUBS of all entries of large tables are known to be in it,
#: so there are fewer than HUBS.
HUBS = 20_000


@dataclass(frozen=True)
class Rule:
    """Shingle size in words, and the least similarity in percent."""

    size: int = 4
    percent: int = 85

    def overlap(self, total):
        """Least overlap of two sets with a link, from the sum of their sizes."""
        return -(-self.percent * total // (100 + self.percent))

    def first(self, n):
        """How many shingles of a set of n must be looked at."""
        return n - -(-self.percent * n // 100) + 1

    def steps(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least size, differences of two linked sets at most, and groups of each step of sizes."""
        low = [1]
        while low[-1] <= most * 2:
            low.append(max(low[-1] + 1, low[-1] * 3 // 2))
        low = np.array(low, np.int64)
        differ = 2 * (low[1:] - 1) * (100 - self.percent) // (100 + self.percent)
        return low[:-1], differ, differ + 1 + -(-differ // 8)


def shingle_sets(batch_texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the distinct shingles of each text, by text and hash."""
    offsets, words = hashed_words(batch_texts)
    whole, text = inside(offsets, size, len(words))
    hashes = shingles(words, size)[whole]
    counts = np.diff(offsets)
    few = np.flatnonzero((counts > 0) & (counts < size))
    # fewer words: the whole sequence is one shingle, told apart by its length
    short = np.empty(len(few), np.uint64)
    for i, t in enumerate(few):
        n = counts[t]
        short[i] = mixed(shingles(words[offsets[t] : offsets[t + 1]], n)[:1] + np.uint64(n))[0]
    text = np.concatenate([text, few])
    hashes = np.concatenate([hashes, short])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def _cells_of(rule: Rule, text: np.ndarray, hashes: np.ndarray, counts: np.ndarray):
    """Text and key of the cells of each text; the shingles come by text and hash."""
    low, differ, groups = rule.steps(int(counts.max(initial=1)))
    step = np.searchsorted(low, counts, "right") - 1
    # the largest set that can be linked may be a step further
    further = (100 * counts // rule.percent >= low[step + 1]) & (counts > 0)
    for chosen, at in ((counts > 0, step), (further, step + 1)):
        # sets that may not differ at all are linked only to their own class
        chosen = chosen & (differ[at] > 0)
        own = chosen[text]
        t, h = text[own], hashes[own]
        if not len(t):
            continue
        m = groups[at]
        group = ((h >> np.uint64(32)) * m[t].astype(np.uint64)) >> np.uint64(32)
        begins = np.ones(len(t), bool)
        begins[1:] = (t[1:] != t[:-1]) | (group[1:] != group[:-1])
        begins = np.flatnonzero(begins)
        total = np.add.reduceat(mixed(h + np.uint64(3)), begins)
        place = at[t[begins]].astype(np.uint64) << np.uint64(40) | group[begins]
        yield t[begins], mixed(mixed(total) + mixed(place))
        # empty groups could be all that a pair agrees in
        full = np.bincount(t[begins], minlength=len(counts))
        bare = chosen & (m - full >= m - differ[at])
        if bare.any():
            starts = np.cumsum(counts) - counts
            early = bare[text] & (np.arange(len(text)) - starts[text] < rule.first(counts)[text])
            place = at[text[early]].astype(np.uint64) << np.uint64(40) | np.uint64(1 << 39)
            yield text[early], mixed(mixed(hashes[early]) + mixed(place))


def _kind(most: int) -> str:
    """The kind of integers, in as few bytes as hold ``most``."""
    return "u1" if most < 2**8 else "<u2" if most < 2**16 else "<i4"


#: Kinds of the coordinates of a vector, by their bytes.
_KINDS = {1: "u1", 2: "<u2", 4: "<i4"}


def _sketch(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, TEXTS):
            n_rows = batch.num_rows
            text, hashes = shingle_sets(batch["text"], rule.size)
            counts = np.bincount(text, minlength=n_rows)
            starts = np.cumsum(counts) - counts
            group = (hashes >> np.uint64(20)).astype(np.int64) % GROUPS
            vector = np.bincount(text * GROUPS + group, minlength=n_rows * GROUPS).reshape(n_rows, GROUPS)
            sums = []
            for salt in (1, 2):
                total = np.append(np.uint64(0), np.cumsum(mixed(hashes + np.uint64(salt))))
                sums.append((total[starts + counts] - total[starts]).view(np.int64))
            none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            of, cell = (np.concatenate(x) for x in zip(none, *_cells_of(rule, text, hashes, counts), strict=True))
            order = np.argsort(of, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(of, minlength=n_rows)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(counts),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.array([v.astype(_kind(m)).tobytes() for v, m in zip(vector, vector.max(1), strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell[order].view(np.int64))),
                ],
                ["doc_id", "n", "s1", "s2", "vector", "cells"],
            )

    return run


def sketches(documents: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, two sums that name the set, count vector and cells of each row."""
    return stored(
        documents.mapInArrow(
            _sketch(rule),
            "doc_id bigint, n bigint, s1 bigint, s2 bigint, vector binary, cells array<bigint>",
        ),
        "jaccard",
    )


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each group of hashes whether a set has an odd number in it, packed in bytes.

    A set of half the groups has the groups of the larger one put together in twos: group
    i with i + half, so that its parity is that of the larger one folded.
    """
    groups = min(max(1 << (2 * len(hashes)).bit_length(), LEAST_GROUPS), MOST_GROUPS)
    held = np.bincount((hashes >> np.uint64(8)).astype(np.int64) & (groups - 1), minlength=groups)
    return np.packbits((held & 1).astype(np.uint8))


def least_difference(one: np.ndarray, other: np.ndarray) -> int:
    """How many shingles two sets differ in at least, by their parities."""
    if len(one) < len(other):
        one, other = other, one
    while len(one) > len(other):
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    return int(np.bitwise_count(one ^ other).sum())


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, TEXTS):
            text, hashes = shingle_sets(batch["text"], size)
            counts = np.bincount(text, minlength=batch.num_rows)
            ends = np.append(0, np.cumsum(counts))
            sets = [hashes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(counts),
                    pa.array([parity(s).tobytes() for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["node", "n", "parity", "shingles"],
            )

    return run


def _may_link(rule: Rule):
    """The pairs whose parities (p, q) leave room for a link of sets of m and n shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch["m"].to_numpy() + batch["n"].to_numpy()
            least = [
                least_difference(*(np.frombuffer(v.as_buffer(), np.uint8) for v in two))
                for two in zip(batch["p"], batch["q"], strict=True)
            ]
            may = np.array(least, np.int64) <= total - 2 * rule.overlap(total)
            yield batch.select(["a", "b"]).filter(pa.array(may))

    return run


@run("jaccard-links")
def verified(pairs: DataFrame, documents: DataFrame, rule: Rule) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose documents have a link."""
    pairs = stored(pairs, "jaccard-pairs")
    nodes = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "jaccard-nodes")
    # most texts are in no pair, and stay where they are
    texts, _ = sifted(documents, nodes, F.col("doc_id"), F.col("node"))
    sets = stored(
        texts.join(nodes, F.col("doc_id") == F.col("node"))
        .dropDuplicates(["doc_id"])
        .select("doc_id", "text")
        .mapInArrow(_sets(rule.size), "node bigint, n bigint, parity binary, shingles binary"),
        "jaccard-sets",
    )
    near = stored(
        pairs.join(sets.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("parity").alias("p")), "a")
        .join(sets.select(F.col("node").alias("b"), "n", F.col("parity").alias("q")), "b")
        .select("a", "b", "m", "n", "p", "q")
        .mapInArrow(_may_link(rule), "a bigint, b bigint"),
        "jaccard-near",
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                one = np.frombuffer(x.as_buffer(), np.uint64)
                other = np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * both >= rule.percent * (len(one) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (
        near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(check, "a bigint, b bigint")
    )


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Cell and doc_id of the entries of a batch, by cell; of rows with the same set one goes in."""
    sums = np.stack([batch[k].to_numpy() for k in ("doc_id", "n", "s2", "s1")])
    order = np.lexsort(sums)
    new = np.ones(len(order), bool)
    new[1:] = (sums[1:, order[1:]] != sums[1:, order[:-1]]).any(0)
    batch = batch.take(pa.array(np.sort(order[new])))
    cells = batch["cells"]
    node = np.repeat(batch["doc_id"].to_numpy(), pc.list_value_length(cells).to_numpy())
    cell = cells.flatten().to_numpy().view(np.uint64)
    by = np.argsort(cell, kind="stable")
    return cell[by], node[by]


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell, held = np.unique(_entries(batch)[0], return_counts=True)
        often = held >= max(2, held.sum() // HUBS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cell[often].view(np.int64)), pa.array(held[often])], ["cell", "held"]
        )


def _dealt(bits: int, hubs):
    """Entries of all cells but hubs, packed; those of the hubs if ``bits`` is negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, node = _entries(batch)
            at_hub = np.isin(cell, hubs.value)
            if bits < 0:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[at_hub].view(np.int64)), pa.array(node[at_hub])], ["cell", "node"]
                )
                continue
            cell, node = cell[~at_hub], node[~at_hub]
            bucket = (cell >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(cell), np.int64)
            begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(cell)])
            ends = np.append(begins[1:], len(cell))
            pieces = [
                pa.array([x[a:b].tobytes() for a, b in zip(begins, ends, strict=False)], pa.binary())
                for x in (cell, node)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[begins]), *pieces], ["bucket", "cells", "nodes"])

    return run


def _met(table: pa.Table) -> pa.Table:
    """Entries of the cells of a bucket that have two or more."""
    cell = np.frombuffer(b"".join(table["cells"].to_pylist()), np.uint64)
    node = np.frombuffer(b"".join(table["nodes"].to_pylist()), np.int64)
    order = np.argsort(cell, kind="stable")
    cell, node = cell[order], node[order]
    same = cell[1:] == cell[:-1]
    kept = np.append(same, False) | np.append(False, same)
    return pa.table({"cell": cell[kept].view(np.int64), "node": node[kept]})


def crowded(each: DataFrame) -> DataFrame:
    """cell and node of the entries of ``each`` (of ``sketches``) that are not alone in their cell.

    Entries are dealt into buckets of cells as packed arrays, one row a batch and bucket.
    Hubs, fewer than HUBS cells, are known from counts of batches first and are not dealt,
    so a bucket has no cell with a large share of all documents. They come back with all
    their entries, alone or not.
    """
    each = each.select("doc_id", "n", "s1", "s2", "cells")
    entries = each.agg(F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()[0]
    bits = int(entries // BUCKET).bit_length()
    hubs = np.zeros(0, np.uint64)
    if entries > BUCKET * 100:  # below, any cell fits into a task
        often = each.mapInArrow(_often, "cell bigint, held bigint").groupBy("cell").agg(F.sum("held").alias("held"))
        rows = often.filter(F.col("held") * HUBS > entries).select("cell").toPandas()
        hubs = rows["cell"].to_numpy(np.int64).view(np.uint64)
    known = each.sparkSession.sparkContext.broadcast(hubs)
    found = (
        each.mapInArrow(_dealt(bits, known), "bucket bigint, cells binary, nodes binary")
        .groupBy("bucket")
        .applyInArrow(_met, "cell bigint, node bigint")
    )
    if not len(hubs):
        return found
    return found.union(each.mapInArrow(_dealt(-1, known), "cell bigint, node bigint"))


_BYTES, _SHORTS = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0000FFFF0000FFFF)


def overlaps(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Sums of the coordinate minima of vectors that are broadcast against each other."""
    least = np.minimum(one, other)
    if least.dtype != np.uint8:
        return least.sum(-1, dtype=np.int64)
    # bytes are added up eight at a time: GROUPS / 4 of them fit into a lane of 16 bits
    words = least.view(np.uint64)
    total = ((words & _BYTES) + ((words >> np.uint64(8)) & _BYTES)).sum(-1)
    total = (total & _SHORTS) + ((total >> np.uint64(16)) & _SHORTS)
    return ((total & np.uint64(0xFFFFFFFF)) + (total >> np.uint64(32))).astype(np.int64)


def _sizes_fit(rule: Rule, one, other):
    return (100 * other >= rule.percent * one) & (100 * one >= rule.percent * other)


def _passing(rule: Rule, vectors: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Of the pairs (i, j) of entries those that pass the bound."""
    fits = _sizes_fit(rule, sizes[i], sizes[j])
    i, j = i[fits], j[fits]
    bound = [overlaps(vectors[i[a : a + CHUNK]], vectors[j[a : a + CHUNK]]) for a in range(0, len(i), CHUNK)]
    close = np.concatenate([np.zeros(0, np.int64), *bound]) >= rule.overlap(sizes[i] + sizes[j])
    return i[close], j[close]


class Tree:
    """An R-tree over count vectors, packed by sorting along one axis after another."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray) -> None:
        def pack(part: np.ndarray, axis: int) -> list[np.ndarray]:
            if len(part) <= LEAF:
                return [part]
            by = part[np.argsort(sizes[part] if axis < 0 else vectors[part, axis], kind="stable")]
            cut = max(LEAF, -(-len(part) // 8))
            widest = lambda p: int(np.ptp(vectors[p], axis=0).argmax())
            return [leaf for i in range(0, len(by), cut) for leaf in pack(by[i : i + cut], widest(by[i : i + cut]))]

        self.vectors, self.sizes = vectors, sizes
        self.leaves = pack(np.arange(len(vectors)), -1)
        self.upper = np.array([vectors[p].max(0) for p in self.leaves])
        self.low = np.array([sizes[p].min() for p in self.leaves])
        self.high = np.array([sizes[p].max() for p in self.leaves])

    def joined(self, other: Tree, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entries of this tree and of the other whose bound allows a link."""
        for k, leaf in enumerate(self.leaves):
            fits = (100 * other.high >= rule.percent * self.low[k]) & (100 * self.high[k] >= rule.percent * other.low)
            near = np.flatnonzero(fits)
            bound = overlaps(other.upper[near], self.upper[k])
            near = near[bound >= rule.overlap(self.low[k] + other.low[near])]
            if not len(near):
                continue
            entries = np.concatenate([other.leaves[i] for i in near])
            own, n = self.vectors[leaf][:, None], self.sizes[leaf][:, None]
            for a in range(0, len(entries), CHUNK // LEAF):
                part = entries[a : a + CHUNK // LEAF]
                sizes = other.sizes[part]
                close = _sizes_fit(rule, n, sizes) & (overlaps(own, other.vectors[part]) >= rule.overlap(n + sizes))
                if other is self:
                    close &= part > leaf[:, None]
                i, j = np.nonzero(close)
                yield leaf[i], part[j]


@dataclass
class Entries:
    """What a block holds: entries of one cell or of several, by cell."""

    cells: np.ndarray
    nodes: np.ndarray
    labels: np.ndarray
    sizes: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, block: dict) -> Entries:
        cells, *rest = (np.frombuffer(block[k], np.int64) for k in ("cells", "nodes", "labels", "sizes"))
        kind = _KINDS[len(block["vectors"]) // (len(cells) * GROUPS)]
        return cls(cells, *rest, np.frombuffer(block["vectors"], kind).reshape(-1, GROUPS))

    def __getitem__(self, which) -> Entries:
        return Entries(*(v[which] for v in (self.cells, self.nodes, self.labels, self.sizes, self.vectors)))

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each cell begins, and how many entries it has."""
        begins = np.flatnonzero(np.append(True, self.cells[1:] != self.cells[:-1]))
        return begins, np.diff(np.append(begins, len(self.cells)))

    def few(self, rule: Rule, across: bool) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that pass the bound in cells of SMALL entries at most, many cells at once.

        Such a cell is a leaf or two, of which all entries meet. With ``across`` those of
        one label do not.
        """
        begins, held = self.ranges()
        found = [np.zeros((2, 0), np.int64)]
        for size in np.unique(held[(held > 1) & (held <= SMALL)]):
            one, other = np.triu_indices(size, 1)
            at = begins[held == size][:, None]
            step = max(1, CHUNK * 16 // len(one))
            for a in range(0, len(at), step):
                i, j = (at[a : a + step] + one).ravel(), (at[a : a + step] + other).ravel()
                if across:
                    far = self.labels[i] != self.labels[j]
                    i, j = i[far], j[far]
                found.append(np.stack(_passing(rule, self.vectors, self.sizes, i, j)))
        return tuple(np.concatenate(found, axis=1))

    def large(self) -> Iterator[Entries]:
        """The cells of more than SMALL entries, one at a time."""
        for a, n in zip(*self.ranges(), strict=True):
            if n > SMALL:
                yield self[a : a + n]


def _linkable(rule: Rule, one: Entries, other: Entries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entries of a cell in two blocks, or in one, of different labels, that may be linked.

    Most entries of a large cell may have one label. They are not compared with each other,
    only with the rest.
    """
    same = other is one
    labels, held = np.unique(np.concatenate([one.labels, other.labels]), return_counts=True)
    top = labels[held.argmax()]
    most, rest = (np.flatnonzero(x) for x in (one.labels == top, one.labels != top))
    others = rest if same else np.flatnonzero(other.labels != top)
    tree = lambda side, which: Tree(side.vectors[which], side.sizes[which])
    few = tree(one, rest) if len(rest) else None
    if same:
        joins = [(rest, few, rest, few)]
    else:
        everything = np.arange(len(other.nodes))
        joins = [(rest, few, everything, tree(other, everything) if len(rest) else None)]
    if len(most) and len(others):
        joins.append((most, tree(one, most), others, few if same else tree(other, others)))
    for own, x, theirs, y in joins:
        if x is None:
            continue
        for i, j in x.joined(y, rule):
            i, j = own[i], theirs[j]
            far = one.labels[i] != other.labels[j]
            yield i[far], j[far]


def _nodes(pairs: list[np.ndarray]) -> pa.RecordBatch:
    """The pairs of nodes, each once, the lesser node first."""
    pairs = np.unique(np.sort(np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1), axis=0), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _open(block: dict, rule: Rule) -> pa.RecordBatch:
    """Nodes of a block, of one cell but different components, that may be linked."""
    entries = Entries.of(block)
    i, j = entries.few(rule, across=True)
    pairs = [np.stack([entries.nodes[i], entries.nodes[j]])]
    for cell in entries.large():
        pairs += [np.stack([cell.nodes[i], cell.nodes[j]]) for i, j in _linkable(rule, cell, cell)]
    return _nodes(pairs)


def _tried(rule: Rule, cell: Entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a large cell, an entry for each that it passes the bound with, and a measure of it.

    JUDGES entries of all sizes tell which pass the bound with many; each entry tries the
    JUDGES best of them in turn, so the work does not grow with the square of the cell.
    What is not tried here is still met when ``open_pairs`` are formed.
    """
    n = len(cell.nodes)
    judges = np.argsort(cell.sizes, kind="stable")[np.linspace(0, n - 1, JUDGES).astype(int)]

    def close(which: np.ndarray) -> np.ndarray:
        own, sizes = cell.vectors[which], cell.sizes[which]
        out = np.zeros((n, len(which)), bool)
        for a in range(0, n, CHUNK // JUDGES):
            b = slice(a, a + CHUNK // JUDGES)
            size = cell.sizes[b, None]
            out[b] = _sizes_fit(rule, size, sizes) & (
                overlaps(cell.vectors[b, None], own) >= rule.overlap(size + sizes)
            )
        return out

    passed = close(judges).sum(1)
    best = np.lexsort((cell.nodes, -passed))[:JUDGES]
    good = close(best) & (cell.labels[:, None] != cell.labels[best])
    i = np.flatnonzero(good.any(1))
    j = best[good[i].argmax(1)]
    return i, j, passed[j]


def _best(block: dict, rule: Rule) -> pa.RecordBatch:
    """node, other and passed of each entry that passes the bound with one of another component.

    ``other`` is, of those entries, the one that passes it with the most.
    """
    entries = Entries.of(block)
    nodes, labels = entries.nodes, entries.labels
    i, j = entries.few(rule, across=False)
    passed = np.bincount(np.concatenate([i, j]), minlength=len(nodes))
    far = labels[i] != labels[j]
    i, j = np.concatenate([i[far], j[far]]), np.concatenate([j[far], i[far]])
    told = [(nodes[i], nodes[j], passed[j])]
    for cell in entries.large():
        i, j, many = _tried(rule, cell)
        told.append((cell.nodes[i], cell.nodes[j], many))
    node, other, passed = (np.concatenate(x) for x in zip(*told, strict=True))
    # the greatest of each node
    order = np.lexsort((-other, passed, node))
    last = order[np.append(node[order][1:] != node[order][:-1], True)[: len(order)]]
    return pa.RecordBatch.from_arrays([pa.array(v[last]) for v in (node, other, passed)], ["node", "other", "passed"])


def _packed(rows: pa.Table) -> bytes:
    """The vectors of ``rows``, all of the kind of the widest."""
    vectors = rows["vector"].to_pylist()
    widest = max(map(len, vectors))
    return b"".join(
        v if len(v) == widest else np.frombuffer(v, _KINDS[len(v) // GROUPS]).astype(_KINDS[widest // GROUPS]).tobytes()
        for v in vectors
    )


def _blocks(most: int):
    """Blocks of about ``most`` entries, from rows that come by cell and size.

    A block holds whole cells, and names none, or part of one, of ``most`` entries at most.
    The first and the last cell of a task may be in other tasks too, and so count as parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0

        def made(rows: list[pa.RecordBatch], alone: bool) -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(rows)
            size = rows["n"].to_numpy()
            block = {
                "cell": rows["cell"][0].as_py() if alone else None,
                "block": (TaskContext.get().partitionId() << 40) + number,
                "low": int(size.min()),
                "high": int(size.max()),
                **{k: rows[c].to_numpy().tobytes() for k, c in (("cells", "cell"), ("nodes", "node"), ("labels", "label"), ("sizes", "n"))},
                "vectors": _packed(rows),
            }
            number += 1
            return pa.RecordBatch.from_pylist([block], schema=_BLOCK_SCHEMA)

        count = lambda rows: sum(r.num_rows for r in rows)
        # whole cells, and the rows of the last cell so far, which may be a part
        whole, held, of, part = [], [], None, True
        for batch in batches:
            cell = batch["cell"].to_numpy()
            begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
            for a, b in zip(begins, np.append(begins[1:], len(cell)), strict=False):
                if held and of != cell[a]:
                    if part:
                        yield made(held, True)
                    else:
                        whole += held
                        if count(whole) >= most:
                            yield made(whole, False)
                            whole = []
                    held, part = [], False
                of = cell[a]
                while a < b:
                    if (full := count(held)) == most:
                        yield made(held, True)
                        held, full, part = [], 0, True
                    held.append(batch.slice(a, min(b - a, most - full)))
                    a += held[-1].num_rows
        if whole:
            yield made(whole, False)
        if held:
            yield made(held, True)

    return run


_BLOCK = "cell bigint, block bigint, low bigint, high bigint, cells binary, nodes binary, labels binary, sizes binary, vectors binary"
_BLOCK_SCHEMA = pa.schema(
    [(f.split()[0], pa.int64() if f.endswith("bigint") else pa.binary()) for f in _BLOCK.split(", ")]
)


def _within(of: Callable[[dict], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield of(batch.slice(i, 1).to_pylist()[0])

    return run


def _across(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch["x"], batch["y"], strict=True):
                one, other = Entries.of(x.as_py()), Entries.of(y.as_py())
                yield _nodes([np.stack([one.nodes[i], other.nodes[j]]) for i, j in _linkable(rule, one, other)])

    return run


def blocks_of(entries: DataFrame, most: int = BLOCK) -> DataFrame:
    """The cells of ``entries`` (cell, node, label, n, vector) in blocks of about ``most`` entries.

    Rows are sorted over all tasks, so that a cell of any size is cut into blocks.
    """
    return stored(
        entries.repartitionByRange("cell", "n", "node")
        .sortWithinPartitions("cell", "n", "node")
        .mapInArrow(_blocks(most), _BLOCK),
        "jaccard-blocks",
    )


def best_pairs(blocks: DataFrame, rule: Rule) -> DataFrame:
    """For each node a pair (a, b) with one of another label in its blocks that passes the bound."""
    return (
        blocks.mapInArrow(_within(lambda row: _best(row, rule)), "node bigint, other bigint, passed bigint")
        .groupBy("node")
        .agg(F.max(F.struct("passed", "other")).alias("best"))
        .select(F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b"))
        .distinct()
    )


def open_pairs(blocks: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of nodes that share a cell, differ in label and pass the bound.

    Every block is joined with itself and every other one of its cell.
    """
    within = blocks.mapInArrow(_within(lambda row: _open(row, rule)), "a bigint, b bigint")
    several = blocks.filter("cell IS NOT NULL").groupBy("cell").agg(F.count("*").alias("held")).filter("held > 1").select("cell")
    heads = stored(blocks.select("cell", "block", "low", "high").join(several, "cell"), "jaccard-heads")
    x, y = (heads.select("cell", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "low", "high")]) for s in "xy")
    two = x.join(y, "cell").filter(
        (F.col("block_x") < F.col("block_y"))
        & (100 * F.col("high_x") >= rule.percent * F.col("low_y"))
        & (100 * F.col("high_y") >= rule.percent * F.col("low_x"))
    )
    whole = lambda s: blocks.select(
        F.col("block").alias(f"block_{s}"), F.struct("cells", "nodes", "labels", "sizes", "vectors").alias(s)
    )
    across = (
        two.select("block_x", "block_y")
        .join(whole("x"), "block_x")
        .join(whole("y"), "block_y")
        .select("x", "y")
        .mapInArrow(_across(rule), "a bigint, b bigint")
    )
    return within.union(across).filter("a < b").distinct()


def _still_open(entries: DataFrame, found: DataFrame) -> DataFrame:
    """cell, node, n and label of the entries of cells with different components of ``found``."""
    labels = components(found)
    labelled = stored(
        entries.select("cell", "node", "n")
        .join(labels, "node", "left")
        .select("cell", "node", "n", F.coalesce("component", "node").alias("label")),
        "jaccard-labelled",
    )
    several = (
        labelled.groupBy("cell")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low <> high")
        .select("cell")
    )
    several = stored(several, "jaccard-mixed")
    left = stored(labelled.join(several, "cell"), "jaccard-open")
    drop(labels, labelled, several)
    return left


def links(each: DataFrame, names: DataFrame, documents: DataFrame, rule: Rule) -> DataFrame:
    """Verified pairs (a, b) of classes that make the same components as all links.

    ``each`` comes from ``sketches``, ``names`` has doc_id, node (of its class) and n,
    ``documents`` the texts of the nodes.
    """
    met = stored(crowded(each), "jaccard-met")
    entries = stored(
        met.withColumnRenamed("node", "doc_id").join(names, "doc_id").select("cell", "node", "n").distinct(),
        "jaccard-entries",
    )
    cells = stored(
        entries.groupBy("cell")
        .agg(
            F.count("*").alias("held"),
            F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"),
            F.sum(F.xxhash64("node", "n").cast("decimal(38,0)")).alias("sizes"),
        )
        .filter("held > 1")
        # cells with the same members find the same pairs
        .groupBy("held", "members", "sizes")
        .agg(F.min("cell").alias("cell")),
        "jaccard-cells",
    )
    shared = stored(entries.join(cells.select("cell"), "cell"), "jaccard-shared")
    drop(met, entries)
    vectors = stored(
        each.join(shared.select(F.col("node").alias("doc_id")).distinct(), "doc_id")
        .dropDuplicates(["doc_id"])
        .select(F.col("doc_id").alias("node"), "vector"),
        "jaccard-vectors",
    )
    blocks = blocks_of(shared.withColumn("label", F.col("node")).join(vectors, "node"))
    found = verified(best_pairs(blocks, rule), documents, rule)
    drop(blocks)
    left = _still_open(shared, found)
    drop(shared)
    blocks = blocks_of(left.join(vectors, "node"))
    return found.union(verified(open_pairs(blocks, rule), documents, rule))


@run("jaccard-joined")
def join(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``documents``.

    component_id is the least doc_id that links lead to, the row's own included. A
    null or empty text, or one without words, has no shingles and links with nothing.
    Rows given twice are the same document. A row with a null id has a null
    component_id, and leads to nothing.
    """
    ready = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    each = sketches(ready, rule)
    narrow = each.select("doc_id", "n", "s1", "s2")
    named = each.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = stored(
        named.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node")), "jaccard-classes"
    )
    names = stored(
        named.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).select("doc_id", "node", "n").distinct(),
        "jaccard-names",
    )
    labels = components(links(named, names, ready, rule))
    known = classes.join(labels, "node", "left").select(
        "n", "s1", "s2", F.coalesce("component", "node").alias("component_id")
    )
    return (
        narrow.join(known, ["n", "s1", "s2"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )


@run("jaccard-gone")
def superfluous(documents: DataFrame, rule: Rule) -> DataFrame:
    """doc_id of the documents that are not the least of their component."""
    return join(documents, rule).filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()


def keep_one(documents: DataFrame, rule: Rule) -> DataFrame:
    """One row of each component, that of the least doc_id, with all its columns.

    Rows that share a doc_id are one document, and so are rows without one that share a
    text: one row of each stays, which one is not defined. Rows without a doc_id are
    linked with nothing else.
    """
    kept = left_out(documents, superfluous(documents, rule), lambda row: [row["doc_id"].cast("bigint")])
    name = F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit(""))))
    again = stored(
        documents.groupBy(F.col("doc_id").cast("bigint").alias("id"), name.alias("name")).count().filter("count > 1").drop("count"),
        "jaccard-again",
    )
    if again.isEmpty():
        return kept
    row = F.col("row")
    key = [row["doc_id"].cast("bigint"), F.when(row["doc_id"].isNull(), F.xxhash64(F.coalesce(row["text"], F.lit(""))))]
    rows = kept.select(F.struct("*").alias("row"))
    several = rows.withColumns({"id": key[0], "name": key[1]}).join(
        again.toDF("again_id", "again_name"),
        F.col("id").eqNullSafe(F.col("again_id")) & F.col("name").eqNullSafe(F.col("again_name")),
        "left_semi",
    )
    one = several.groupBy("id", "name").agg(F.first("row").alias("row"))
    once = left_out(kept, again, lambda row: key)
    return once.union(one.select(fields(documents)))


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all ``documents`` at four words and 85 percent."""
    return join(read_table(spark, folder, "documents"), Rule(4, 85))
