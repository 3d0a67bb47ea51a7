"""Periodic run detection by scale-tiled distribution.

A run is a longest stretch of words that repeat with a period q, at least four times and
over six words. Periods are dealt into octaves [2^k, 2^(k+1)), and for each octave a text
is laid out in overlapping tiles, the longer the octave the longer the tile. A tile has a
boundary every 2^k words. A run whose period is in the octave is so long that two
boundaries c next to each other, at least, see the next 2^k words again q words later.

1. Tiles are solved independently. For each boundary c and each q of the octave the
   Z-function at c (how far the text from c on and from c + q on agree) is looked up to
   2^k by block hashes; neighbouring boundaries that reach so far with the same q are one
   fragment, whose ends are then extended word by word past the first and last boundary.
   Multiples of a shorter period are left out: that period has its own fragment.
2. Fragments are shuffled by document and period, and those that overlap by a period or
   more are stitched. A stretch with two periods that is as long as both together has
   their common divisor as period, so what is stitched is one run, and one with a multiple
   of a period is nothing new.
3. Runs go to the texts with fragments, which step 1 has put aside; other texts are not
   moved. Words after the first period of a run are dropped.

Step 1 takes about 30 bytes a word of the batch's texts (a batch is about 8 MB, or one
text if that is longer), whatever the periods.

Cases: null, empty and blank texts have no words, thus no runs and an empty collapsed
text. Rows that share doc_id and text get the same result each; a null doc_id is treated
like any other. Of runs with the same exponent the one that starts first is the greatest,
then that with the shorter period. Only doc_id and text are read. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import let, run, stored, text_of, words_of
from ledgerline.llm.word_hashes import mixed, parts
from ledgerline.sources import read_table

#: A run has REPEATS periods and LEAST_WORDS words, or more.
REPEATS = 4
LEAST_WORDS = 6
#: Words of the core of a tile, and boundaries of it, at least.
TILE_WORDS = 4096
TILE_BOUNDARIES = 8
#: Words compared at once where fragments are extended.
AT_ONCE = 4_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)

FRAGMENTS = "array<struct<period:bigint,start:bigint,end:bigint>>"


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    r"""Offsets of the texts in their words ``[^\x20\x09-\x0D]+``, and the words."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    split = pc.ascii_split_whitespace(texts)
    counts = np.diff(split.offsets.to_numpy().astype(np.int64))
    words = split.flatten()
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # an empty text is split into one empty word
        words = words.filter(pa.array(np.repeat(~empty, counts)))
        counts = np.where(empty, 0, counts)
    return np.append(0, np.cumsum(counts)), words


def joined(offsets: np.ndarray, words: pa.Array) -> pa.Array:
    """The words of each text with one space between them."""
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each start, count of them."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


def _same_ahead(ids: np.ndarray, at: np.ndarray, shift: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, in the direction of ``step``, equal those ``shift`` later."""
    out = np.zeros(len(at), np.int64)
    widest = int(most.max(initial=0))
    if not widest:
        return out
    rows = max(1, AT_ONCE // widest)
    for i in range(0, len(at), rows):
        a, q, n = at[i : i + rows], shift[i : i + rows], most[i : i + rows]
        along = np.arange(widest)
        inside = along < n[:, None]
        place = np.where(inside, a[:, None] + step * along, 0)
        agree = inside & (ids[place] == ids[np.where(inside, place + q[:, None], 0)])
        out[i : i + rows] = np.where(agree.all(1), widest, agree.argmin(1))
    return out


def _primitive(block: np.ndarray, size: int, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether no divisor of the period is a period of the period + size words from ``at`` on.

    ``block`` has the hashes of all runs of ``size`` words; size <= period < 2 * size.
    """
    out = np.ones(len(at), bool)
    if size == 1:
        return out
    least = np.arange(2 * size)  # least prime factor
    for p in range(2, int((2 * size) ** 0.5) + 1):
        if least[p] == p:
            multiples = least[p * p :: p]
            multiples[multiples == np.arange(p * p, 2 * size, p)] = p
    rest = period.copy()
    while (open_ := rest > 1).any():
        prime = np.where(open_, least[rest], 1)
        part = period // prime
        last = period - part  # the last block to compare starts here
        again = open_.copy()
        for place in (np.zeros_like(last), np.minimum(size, last), last):
            again &= block[at + place] == block[at + part + place]
        out &= ~again
        rest = np.where(open_, rest // prime, rest)
    return out


def fragments(offsets: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """text, period, start and end of the fragments of one octave after another.

    ``ids`` numbers the words of all texts, ``offsets`` says where each text begins.
    """
    counts = np.diff(offsets)
    block, size = mixed(ids.astype(np.uint64) + np.uint64(1)), 1
    while True:
        texts = np.flatnonzero(counts >= max(LEAST_WORDS, REPEATS * size))
        if not len(texts):
            return
        # x runs through the words that a boundary's block may come back at: those of
        # the next 2^k words, so that each word has one boundary to be compared with
        n = counts[texts] - 2 * size + 1
        x = _ranges(offsets[texts] + size, n)
        begin = np.repeat(offsets[texts], n)
        boundary = x - ((x - begin) & (size - 1)) - size
        hit = np.flatnonzero(block[x] == block[boundary])
        if len(hit):
            core = max(TILE_WORDS, TILE_BOUNDARIES * size)
            text = np.repeat(texts, n)[hit]
            begin, c, q = begin[hit], boundary[hit], (x - boundary)[hit]
            tile = (c - begin) // core
            order = np.lexsort((c, q, tile, text))
            text, begin, c, q, tile = text[order], begin[order], c[order], q[order], tile[order]
            new = np.ones(len(c), bool)
            new[1:] = (text[1:] != text[:-1]) | (tile[1:] != tile[:-1]) | (q[1:] != q[:-1]) | (np.diff(c) != size)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(c)) - 1
            text, begin, tile, q, c_first, c_last = text[first], begin[first], tile[first], q[first], c[first], c[last]
            end = offsets[text + 1]
            # a run has two boundaries, unless the tile beside has the other one
            edge = (c_first == begin + tile * core) & (tile > 0)
            edge |= (c_last == begin + (tile + 1) * core - size) & (c_last + size + q + size <= end)
            good = (last > first) | edge
            good[good] = _primitive(block, size, c_first[good], q[good])
            text, begin, end, q, c_first, c_last = (v[good] for v in (text, begin, end, q, c_first, c_last))
            left = _same_ahead(ids, c_first - 1, q, np.minimum(size, c_first - begin), -1)
            after = c_last + size
            right = _same_ahead(ids, after, q, np.minimum(size, end - after - q), 1)
            start, stop = c_first - left, after + q + right
            cut = ((left == size) & (start > begin)) | ((right == size) & (stop < end))
            kept = cut | (stop - start >= np.maximum(LEAST_WORDS, REPEATS * q))
            yield text[kept], q[kept], (start - begin)[kept], (stop - begin)[kept]
        block = block.copy()
        block[: max(len(block) - size, 0)] = mixed(block[: max(len(block) - size, 0)] * _ODD + block[size:])
        size *= 2


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 8_000_000):
        offsets, words = word_lists(batch["text"])
        ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        found = [np.zeros((4, 0), np.int64), *(np.stack(f) for f in fragments(offsets, ids))]
        text, period, start, end = np.concatenate(found, axis=1)
        order = np.argsort(text, kind="stable")
        held = np.bincount(text, minlength=batch.num_rows)
        pieces = pa.StructArray.from_arrays(
            [pa.array(v[order]) for v in (period, start, end)], ["period", "start", "end"]
        )
        plain = joined(offsets, words).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                batch["mark"],
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), pieces),
                pa.array([t if n else None for t, n in zip(plain, held, strict=True)], pa.string()),
                pa.array([None if n else hashlib.sha256(t.encode()).hexdigest() for t, n in zip(plain, held, strict=True)]),
            ],
            ["doc_id", "mark", "fragments", "text", "sha256"],
        )


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 8_000_000):
        offsets, words = word_lists(batch["text"])
        runs = batch["runs"]
        of = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(runs), 0).to_numpy())
        each = runs.flatten()
        start, length, period = (each.field(n).to_numpy(zero_copy_only=False) for n in ("start", "length", "period"))
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, offsets[of] + start + period, 1)
        np.add.at(cover, offsets[of] + start + length, -1)
        kept = np.cumsum(cover)[: len(words)] == 0
        left = joined(np.append(0, np.cumsum(kept))[offsets], words.filter(pa.array(kept)))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], runs, left.cast(pa.string())], ["doc_id", "runs", "collapsed"]
        )


def stitched(fragments: DataFrame) -> DataFrame:
    """doc_id, mark, period, start and length of the runs that fragments of each period make."""
    each = Window.partitionBy("doc_id", "mark", "period").orderBy("start", "end")
    before = F.max("end").over(each.rowsBetween(Window.unboundedPreceding, -1))
    return (
        fragments.withColumn("new", F.coalesce(F.col("start") + F.col("period") > before, F.lit(True)))
        .withColumn("number", F.sum(F.col("new").cast("int")).over(each))
        .groupBy("doc_id", "mark", "period", "number")
        .agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
        .filter((F.col("length") >= LEAST_WORDS) & (F.col("length") >= REPEATS * F.col("period")))
        .select("doc_id", "mark", "period", "start", "length")
    )


@run("runs")
def find_runs(documents: DataFrame) -> DataFrame:
    """doc_id, runs, collapsed and collapsed_sha256 of each row of ``documents``.

    ``runs`` has start (number of a word), length and period of each run, by start and
    period. ``collapsed`` is the text without what repeats, its words joined by one space;
    null where the text has nothing like a run, and its words stay as they are.
    """
    marked = documents.select(
        "doc_id", F.xxhash64(text_of(), F.length(text_of())).alias("mark"), F.col("text").cast("string")
    )
    kind = marked.schema["doc_id"].dataType.simpleString()
    solved = stored(
        marked.mapInArrow(
            _solve, f"doc_id {kind}, mark bigint, fragments {FRAGMENTS}, text string, sha256 string"
        ),
        "run-fragments",
    )
    runs = (
        stitched(solved.select("doc_id", "mark", F.inline("fragments")))
        .groupBy("doc_id", "mark")
        .agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
        .select(F.col("doc_id").alias("run_id"), F.col("mark").alias("run_mark"), "runs")
    )
    shape = "array<struct<start:bigint,period:bigint,length:bigint>>"
    none = F.array().cast(shape)
    held = (
        solved.filter("text IS NOT NULL")
        .join(runs, F.col("doc_id").eqNullSafe(F.col("run_id")) & (F.col("mark") == F.col("run_mark")), "left")
        .select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
        .mapInArrow(_collapse, f"doc_id {kind}, runs {shape}, collapsed string")
        .withColumn("collapsed_sha256", F.sha2(F.col("collapsed").cast("binary"), 256))
    )
    plain = solved.filter("text IS NULL").select(
        "doc_id",
        none.alias("runs"),
        F.lit(None).cast("string").alias("collapsed"),
        F.col("sha256").alias("collapsed_sha256"),
    )
    return held.union(plain)


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document, by hash, repeats itself from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(
            n > 0,
            F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, at(i))), " "),
        )

    text = text_of()
    changed = F.when(h % 10 == 0, F.coalesce(let(words_of(text), planted), text)).otherwise(text)
    return documents.select("doc_id", changed.alias("text"))


def greatest(runs: Column) -> Column:
    """The run of the greatest length / period; null for none. Exact for texts below 2^31 words."""

    def better(x: Column, y: Column) -> Column:
        first, other = x["length"] * y["period"], y["length"] * x["period"]
        return (first > other) | (
            (first == other)
            & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"])))
        )

    return F.aggregate(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, x: F.when(better(x, best), x).otherwise(best),
    )


def op11_period_runs(spark: SparkSession, folder: str) -> DataFrame:
    """``find_runs`` over the whole table ``documents``, after the contract's planting."""
    found = find_runs(with_planted_runs(read_table(spark, folder, "documents")))
    line = lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", greatest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


#: Periods are tried at their own multiples: a run holds three of them in a row, so that
#: words compared there (and half a period on) leave few periods to be looked at in full.
SQL = r"""
WITH h AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           xor(4294967295, list_reduce(
               [4294967295] || [ascii(c)::BIGINT for c in string_split(doc_id::VARCHAR, '')],
               lambda x, b: list_reduce([xor(x, b)] || repeat([0::BIGINT], 8),
                   lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) AS h
    FROM documents
), d AS (
    SELECT r, doc_id, w, len(w) AS n, coalesce(h % 10 = 0, false) AS planted,
           CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a,
           CASE WHEN len(w) > 0 THEN 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) END AS p
    FROM h
), old AS (
    SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d
), moved AS MATERIALIZED (
    SELECT r, i, CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END AS source
    FROM (SELECT *, unnest(range(n)) AS i FROM d)
), t AS MATERIALIZED (
    SELECT moved.r, moved.i, word FROM moved JOIN old ON old.r = moved.r AND old.i = moved.source
), tried AS MATERIALIZED (
    SELECT r, q, unnest(range(0, n - 2 * q, q)) AS i FROM (SELECT r, n, unnest(range(1, n // 4 + 1)) AS q FROM d)
), first AS MATERIALIZED (
    SELECT r, q, i, word FROM tried JOIN t USING (r, i)
), second AS MATERIALIZED (
    SELECT x.* FROM first x JOIN t ON t.r = x.r AND t.i = x.i + q AND t.word = x.word
), third AS MATERIALIZED (
    SELECT x.* FROM second x JOIN t ON t.r = x.r AND t.i = x.i + 2 * q AND t.word = x.word
), half AS MATERIALIZED (
    SELECT x.r, q, x.i, t.word FROM third x JOIN t ON t.r = x.r AND t.i = x.i + q // 2
), open AS MATERIALIZED (
    SELECT DISTINCT x.r, q FROM half x JOIN t ON t.r = x.r AND t.i = x.i + q + q // 2 AND t.word = x.word
), ahead AS MATERIALIZED (
    SELECT r, q, i, word FROM open JOIN t USING (r)
), same AS MATERIALIZED (
    SELECT x.r, q, x.i, x.i - row_number() OVER (PARTITION BY x.r, q ORDER BY x.i) AS part
    FROM ahead x JOIN t ON t.r = x.r AND t.i = x.i + q AND t.word = x.word
), runs AS (
    SELECT r, start, length, min(q) AS period
    FROM (SELECT r, q, min(i) AS start, count(*) + q AS length FROM same GROUP BY r, q, part)
    WHERE length >= 6 AND length >= 4 * q GROUP BY r, start, length
), listed AS (
    SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
    FROM runs GROUP BY r
), best AS (
    SELECT * FROM runs QUALIFY row_number() OVER (
        PARTITION BY r ORDER BY 1000000000000::HUGEINT * length // period DESC, start, period) = 1
), gone AS (
    SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), left_over AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM t ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period,
       (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN left_over USING (r)
"""
