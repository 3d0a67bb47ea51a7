"""Quality rules: cross-document line frequency, and plain text counts.

Normalised lines are hashed, and for each host the documents that hold a line
are counted. Lines above the host's limit are boilerplate. A document is rejected
when too little is left of it without them, or when it fails the base rules.

Every step is a DataFrame expression. The texts are read once; what is kept of
them (counts and line hashes) is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import BLANKS, LOWER, UPPER, left_out, let, run, stored, text_of, words_of
from ledgerline.sources import read_table

#: A line is boilerplate for a host if over LINE_SHARE of the host's documents and
#: over LINE_DOCUMENTS documents hold it.
LINE_SHARE = 0.1
LINE_DOCUMENTS = 20
#: A document is depleted when under LEFT_SHARE of its words, or under LEFT_WORDS
#: words, are left.
LEFT_SHARE = 0.5
LEFT_WORDS = 10

SYMBOLS = "#*$%&|<>"


def _normal(line: Column) -> Column:
    """A-Z in lower case, digits as 0, runs of blanks as one space, none at the ends."""
    plain = F.translate(line, UPPER + "123456789", LOWER + "0" * 9)
    return F.trim(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " "))


def _windows(words: Column) -> Column:
    """A hash of each window of five words."""

    def hashes(w: Column) -> Column:
        return F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 4, F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, 5)]),
        )

    return let(words, hashes)


def _covered(windows: Column) -> Column:
    """Words in the windows whose hash occurs twice or more."""

    def twice(s: Column) -> Column:
        at = F.transform(
            s,
            lambda x, i: F.when(
                (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]
            ),
        )
        return F.sort_array(F.filter(at, lambda p: p.isNotNull()))

    def total(p: Column) -> Column:
        steps = F.transform(
            p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(placed, twice), total)


def _lines(lines: Column) -> Column:
    """(hash, words, first of its hash in the document) of each line."""

    def marked(s: Column) -> Column:
        return F.transform(
            s,
            lambda x, i: F.struct(
                x["h"].alias("h"),
                x["n"].alias("n"),
                F.coalesce(x["h"] != F.get(s, i - 1)["h"], F.lit(True)).alias("first"),
            ),
        )

    return let(
        F.sort_array(
            F.transform(
                lines,
                lambda x: F.struct(F.xxhash64(_normal(x)).alias("h"), F.size(words_of(x)).alias("n")),
            )
        ),
        marked,
    )


def text_counts(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, host and the counts of each row of ``documents``.

    A null or empty text has no words and no lines. ``text_key`` tells apart rows
    that share a doc_id; rows that agree in both are one document given twice.
    """
    text = F.col("text")
    found = F.col("windows")
    return (
        documents.select("doc_id", F.col("source").alias("host"), text_of().alias("text"))
        .withColumn("words", words_of(text))
        .withColumn("windows", _windows(F.col("words")))
        .withColumn(
            "with_words", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        )
        .select(
            "doc_id",
            "host",
            F.xxhash64("text", F.length("text")).alias("text_key"),
            F.size("words").cast("bigint").alias("n_words"),
            F.length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, "")))
            .cast("bigint")
            .alias("n_symbols"),
            (F.size("with_words") - F.size(F.array_distinct("with_words")))
            .cast("bigint")
            .alias("n_dup_lines"),
            F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0))
            .otherwise(_covered(found))
            .cast("bigint")
            .alias("n_repeat_words"),
            _lines(F.col("with_words")).alias("lines"),
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        )
    )


def common_lines(
    counts: DataFrame, share: float = LINE_SHARE, least: int = LINE_DOCUMENTS
) -> DataFrame:
    """host and h of the lines held by over ``share`` of a host's documents.

    Every row counts as a document; a line counts once for each. Rows without a
    host (null) form a host of their own.
    """
    hosts = counts.groupBy("host").agg(F.count("*").alias("documents"))
    held = (
        counts.select("host", F.explode("lines").alias("line"))
        .filter("line.first")
        .groupBy("host", F.col("line.h").alias("h"))
        .agg(F.count("*").alias("holders"))
        .filter(F.col("holders") > least)
    )
    return held.join(hosts, held.host.eqNullSafe(hosts.host)).filter(
        F.col("holders") > share * F.col("documents")
    ).select(held.host, "h")


def depleted(
    counts: DataFrame,
    common: DataFrame,
    left_share: float = LEFT_SHARE,
    left_words: int = LEFT_WORDS,
) -> DataFrame:
    """doc_id, text_key and removed_words of the documents with too little left."""
    common = common.select(F.col("host").alias("common_host"), F.col("h").alias("common_h"))
    lines = counts.select("doc_id", "text_key", "host", "n_words", F.explode("lines").alias("line"))
    # a row given twice has its lines twice, so they are put together by line first
    copies = counts.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"))
    removed = (
        lines.join(
            common,
            F.col("host").eqNullSafe(F.col("common_host")) & (F.col("line.h") == F.col("common_h")),
        )
        .groupBy("doc_id", "text_key")
        .agg(F.sum("line.n").alias("all_words"), F.first("n_words").alias("n_words"))
        .filter(
            ((F.col("n_words") - F.col("all_words")) < left_share * F.col("n_words"))
            | (F.col("n_words") - F.col("all_words") < left_words)
        )
    )
    other = removed.select(
        F.col("doc_id").alias("removed_id"), F.col("text_key").alias("removed_key"), "all_words", "n_words"
    )
    left = F.col("n_words") - F.col("removed_words")
    return (
        copies.join(
            other,
            F.col("doc_id").eqNullSafe(F.col("removed_id")) & (F.col("text_key") == F.col("removed_key")),
        )
        .withColumn("removed_words", F.expr("all_words div rows"))
        .filter((left < left_share * F.col("n_words")) | (left < left_words))
        .select("doc_id", "text_key", "removed_words")
    )


def judge(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` with its counts, base_failed and kept."""
    counts = stored(text_counts(documents), "quality")
    gone = depleted(counts, common_lines(counts)).select(
        F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")
    )
    return (
        counts.drop("lines", "host")
        .join(
            gone,
            F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_key") == F.col("gone_key")),
            "left",
        )
        .withColumn("kept", ~F.col("base_failed") & F.col("gone_key").isNull())
    )


@run("quality-rejected")
def rejected(documents: DataFrame) -> DataFrame:
    """doc_id and text_key of the documents that ``judge`` does not keep."""
    counts = stored(text_counts(documents), "quality")
    gone = depleted(counts, common_lines(counts)).select("doc_id", "text_key")
    return gone.union(counts.filter("base_failed").select("doc_id", "text_key")).distinct()


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that ``judge`` keeps, with all their columns.

    The texts stay where they are: only rejected keys are sent to them.
    """
    bad = rejected(documents)

    def key(row: Column) -> list[Column]:
        text = F.coalesce(row["text"], F.lit(""))
        return [row["doc_id"], F.xxhash64(text, F.length(text))]

    return left_out(documents, bad, key)


COLUMNS = [
    "doc_id",
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "kept",
]


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """``judge`` over the whole table ``documents``."""
    return judge(read_table(spark, folder, "documents")).select(COLUMNS)


SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), l AS (
    SELECT r, source, line,
           len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
           trim(regexp_replace(translate(line, '{UPPER}123456789', '{LOWER}000000000'),
                               '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
    FROM (SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
    SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r
), common AS (
    SELECT a.source, norm
    FROM (SELECT source, norm, count(DISTINCT r) AS holders FROM l GROUP BY source, norm) a
    JOIN (SELECT source, count(*) AS documents FROM d GROUP BY source) b ON a.source IS NOT DISTINCT FROM b.source
    WHERE holders > {LINE_DOCUMENTS} AND holders > {LINE_SHARE} * documents
), gone AS (
    SELECT r, sum(n) AS removed
    FROM l JOIN common c ON l.norm = c.norm AND l.source IS NOT DISTINCT FROM c.source GROUP BY r
), g AS (
    SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS gram
    FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1
), covered AS (
    SELECT r, sum(least(5, coalesce(step, 5))) AS n
    FROM (SELECT r, lead(i) OVER (PARTITION BY r ORDER BY i) - i AS step FROM twice) GROUP BY r
), base AS (
    SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
           CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           CAST(coalesce(removed, 0) AS BIGINT) AS removed
    FROM d LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN gone USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND NOT (removed > 0 AND (n_words - removed < {LEFT_SHARE} * n_words
                                 OR n_words - removed < {LEFT_WORDS})) AS kept
FROM base
"""
