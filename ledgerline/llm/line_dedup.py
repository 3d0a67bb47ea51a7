"""Line dedup: lines that many documents hold stay in one of them.

A line's key is the line without blanks at its ends, A-Z in lower case. Lines are
exploded, their keys hashed, and the documents that hold a hash counted. A key of
LEAST_CHARS code points or more, found in LEAST_DOCUMENTS documents or more, loses
its lines in all of them but the one with the largest doc_id. What is left of a text
is put together again by position.

Every step is a DataFrame expression. A text is read twice, once for the hashes of
its lines and once to be rewritten; in between only hashes and positions move.

Cases: a null or empty text is one empty line. Rows that share a doc_id are one
document, so a row given twice counts once and keeps or loses its lines twice. Rows
without a doc_id hold no key, so they count for none and keep none. Other columns,
whatever their names, come through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import BLANKS, ascii_lower, let, run, stored, text_of
from ledgerline.sources import read_table

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
#: A key is a hub when over 1 / HUBS of all long lines have it, so there are fewer than HUBS.
HUBS = 10_000

#: The columns that ``drop_lines`` adds.
ADDED = ["n_lines", "n_dropped"]


def _key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _mark(text: Column) -> Column:
    """128 bits that tell a key, or a text, from others."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def long_lines(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, mark, at, h of each line with a key of ``least_chars`` code points or more.

    ``at`` is the line's number from 0, ``h`` two hashes of the key, 128 bits in all.
    """
    found = F.transform(
        F.split(text_of(), "\n"),
        lambda line, i: let(
            _key(line),
            lambda key: F.when(
                F.length(key) >= least_chars, F.struct(i.alias("at"), _mark(key).alias("h"))
            ),
        ),
    )
    return documents.select(
        "doc_id",
        _mark(text_of()).alias("mark"),
        F.explode(F.filter(found, lambda x: x.isNotNull())).alias("line"),
    ).select("doc_id", "mark", "line.at", "line.h")


def common_keys(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """h, the number of documents that hold it, its lines and the largest doc_id with it.

    The documents of a key are counted from partial counts by key and document, so a
    key with a third of all lines meets in one task only as one row a task.
    """
    return (
        lines.filter("doc_id IS NOT NULL")
        .groupBy("h", "doc_id")
        .agg(F.count("*").alias("lines"))
        .groupBy("h")
        .agg(
            F.count("*").alias("documents"),
            F.sum("lines").alias("lines"),
            F.max("doc_id").alias("keeper"),
        )
        .filter(F.col("documents") >= least_documents)
    )


@run("line-drops")
def dropped_lines(
    documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """doc_id, mark and the numbers of the lines that each text loses; only texts that lose any."""
    lines = stored(long_lines(documents, least_chars), "line-hashes")
    common = stored(common_keys(lines, least_documents), "line-common")
    # fewer than HUBS keys; the lines that have one stay where they are
    hubs = common.filter(F.col("lines") * HUBS > lines.count()).select(
        F.col("h").alias("hub"), F.col("keeper").alias("hub_keeper")
    )
    told = lines.join(F.broadcast(hubs), F.col("h") == F.col("hub"), "left")
    rest = told.filter("hub IS NULL").select("doc_id", "mark", "at", "h")
    gone = told.filter("hub IS NOT NULL").select("doc_id", "mark", "at", F.col("hub_keeper").alias("keeper")).union(
        rest.join(common.select("h", "keeper"), "h").select("doc_id", "mark", "at", "keeper")
    )
    return (
        gone.filter("doc_id IS NULL OR doc_id < keeper")
        .groupBy("doc_id", "mark")
        .agg(F.collect_set("at").alias("gone"))
    )


def drop_lines(
    documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """The rows of ``documents`` with ``text`` rewritten, and with n_lines and n_dropped.

    n_lines counts the lines before any is dropped. A text that loses nothing stays as
    it is, a null one too. ``documents`` has doc_id and text, and neither of ADDED.
    """
    if clash := set(ADDED) & set(documents.columns):
        raise ValueError(f"documents has columns that are to be added: {sorted(clash)}")
    gone = dropped_lines(documents, least_chars, least_documents).withColumnsRenamed(
        {"doc_id": "gone_id", "mark": "gone_mark"}
    )
    # the columns go along in one struct, so that none of their names can clash
    rows = documents.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    lines = F.split(text, "\n")
    joined = rows.join(
        gone,
        F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (_mark(text) == F.col("gone_mark")),
        "left",
    )
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    left = let(
        lines, lambda own: F.transform(F.array_except(numbers, F.col("gone")), lambda i: F.get(own, i))
    )
    rewritten = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *[
            (rewritten if c == "text" else F.col("row").getField(c)).alias(c)
            for c in documents.columns
        ],
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """``drop_lines`` over the whole table ``documents``, with a digest of what is kept."""
    documents = read_table(spark, folder, "documents").select("doc_id", "text")
    return drop_lines(documents).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(text_of().cast("binary"), 256).alias("kept_sha256")
    )


SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
    SELECT r, doc_id, k, lines[k] AS line,
           translate(trim(lines[k], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM d)
), common AS (
    SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= {LEAST_CHARS}
    GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}
), marked AS (
    SELECT r, k, line, keeper IS NOT NULL AND (doc_id IS NULL OR doc_id < keeper) AS gone
    FROM l LEFT JOIN common USING (key)
), kept AS (
    SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text
    FROM marked GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM d JOIN kept USING (r)
"""
