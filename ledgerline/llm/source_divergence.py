"""Source divergence audit: count-cell ranking.

For each language, how far do the term shares of its sources lie from each other, and
which terms does a source use more than its language does? Terms that have the same
counts have the same shares, so nothing is worked out term by term: terms are grouped
into cells by their pair of counts, and a difference is evaluated once a cell.

- Terms of a source: cells by (count in the source, count in the language). Cells of
  equal difference are merged and ranked by their cumulative number of terms; only the
  cells that begin within the wanted ranks are expanded to terms, in UTF-8 order.
- Pairs of sources: cells by (count in the one, count in the other). Cells with a zero
  on one side are what the cells of the other side leave over, so only terms that both
  sources hold are ever paired.

Texts are counted by Arrow batches: bytes that belong to no term become blanks, and the
words between blanks are counted per group. A batch sends one row per group and term.
All else are DataFrame expressions. Shares are whole billionths from decimals, so the
arithmetic is exact.

The result of the pairs has a row for each two sources of a language, so the number of
sources is what a reader can compare, not what grows with the corpus.

Cases: null texts, languages and sources are empty ones. Each row is a document, also one
given twice or without a doc_id. A language without kept terms has pairs of value 0 and no
terms. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import drop, run, stored
from ledgerline.llm.word_hashes import parts
from ledgerline.sources import read_table

#: Lower case for A-Z, blanks for all other ASCII but a-z; the rest as it is.
_TERM_BYTES = np.array(
    [b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256)],
    np.uint8,
)


@dataclass(frozen=True)
class Rule:
    """Least documents of a kept term, the prior count of each, the whole, and the last rank."""

    documents: int = 30
    prior: int = 5
    whole: int = 1_000_000_000
    ranks: int = 50


def terms(texts: pa.Array) -> pa.ListArray:
    """The terms of each text: runs of ASCII letters and of what is not ASCII, A-Z lowered."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    plain = pa.LargeStringArray.from_buffers(
        len(texts), offsets, pa.py_buffer(_TERM_BYTES[raw]), None, 0, texts.offset
    )
    return pc.ascii_split_whitespace(plain)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 32_000_000):
        found = terms(batch["text"])
        names = found.flatten().dictionary_encode()
        lengths = np.diff(found.offsets.to_numpy().astype(np.int64))
        langs, sources = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        real = np.array([bool(x) for x in names.dictionary.to_pylist()], bool)
        index = names.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        kept = real[index] if len(index) else np.zeros(0, bool)
        index, row = index[kept], row[kept]
        if not len(index):
            continue
        # once by document, then by group
        different = len(real)
        by_row, count = np.unique(row * different + index, return_counts=True)
        row, index = np.divmod(by_row, different)
        key, inverse = np.unique(group[row] * different + index, return_inverse=True)
        g, term = np.divmod(key, different)
        lang, source = np.divmod(g, len(sources.dictionary))
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(lang)),
                sources.dictionary.take(pa.array(source)),
                names.dictionary.take(pa.array(term)).cast(pa.string()),
                pa.array(np.bincount(inverse, weights=count).astype(np.int64)),
                pa.array(np.bincount(inverse)),
            ],
            ["lang", "source", "term", "n", "documents"],
        )


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    )


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, term, n and documents of each term of each group."""
    return (
        _plain(documents)
        .mapInArrow(_count, "lang string, source string, term string, n bigint, documents bigint")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    )


def _share(count: Column, total: Column, kept: Column, rule: Rule) -> Column:
    """p of a count, exact for counts of up to 18 digits."""
    up = F.lit(rule.whole).cast("decimal(10,0)") * (count + rule.prior).cast("decimal(19,0)")
    down = (total + rule.prior * kept).cast("decimal(19,0)")
    return F.call_function("div", up, down) + 1


def _group_shares(documents: DataFrame, own: DataFrame, kept: DataFrame, rule: Rule) -> DataFrame:
    """lang, source, terms (V), total (N), lang_total and p0, the share of a count of 0, of each group.

    p0 is null in a language without kept terms, where terms is 0.
    """
    groups = _plain(documents).select("lang", "source").distinct()
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    zero = F.lit(0).cast("bigint")
    return (
        groups.join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            "lang",
            "source",
            F.coalesce("terms", zero).alias("terms"),
            F.coalesce("total", zero).alias("total"),
            F.coalesce("lang_total", zero).alias("lang_total"),
        )
        .withColumn("p0", F.when(F.col("terms") > 0, _share(zero, F.col("total"), F.col("terms"), rule)))
    )


def leading_terms(own: DataFrame, groups: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """lang, source, item, value and rank of the terms with the greatest surplus of each group.

    ``own`` has lang, source, term, n and in_lang, its count in the language.
    """
    keys = ["lang", "source"]
    cells = (
        own.groupBy(*keys, "n", "in_lang")
        .agg(F.count("*").alias("held"))
        .join(groups.select(*keys, "terms", "total", "lang_total"), keys)
        .withColumn(
            "value",
            _share(F.col("n"), F.col("total"), F.col("terms"), rule)
            - _share(F.col("in_lang"), F.col("lang_total"), F.col("terms"), rule),
        )
        .filter("value > 0")
        .select(*keys, "n", "in_lang", "held", "value")
    )
    cells = stored(cells, "divergence-cells")
    best_first = Window.partitionBy(*keys).orderBy(F.desc("value"))
    # each cell has a term at least, so the first ``ranks`` of them hold all that is wanted
    open_values = (
        cells.groupBy(*keys, "value")
        .agg(F.sum("held").alias("held"))
        .withColumn("place", F.row_number().over(best_first))
        .filter(F.col("place") <= rule.ranks)
        .withColumn("before", F.sum("held").over(best_first) - F.col("held"))
        .filter(F.col("before") < rule.ranks)
        .select(*keys, "value", "before")
    )
    in_order = Window.partitionBy(*keys, "value").orderBy("term")
    return (
        own.join(cells.join(open_values, [*keys, "value"]).drop("held"), [*keys, "n", "in_lang"])
        .withColumn("place", F.row_number().over(in_order))
        .filter(F.col("place") <= rule.ranks)
        .withColumn("rank", F.col("before") + F.col("place"))
        .filter(F.col("rank") <= rule.ranks)
        .select(*keys, F.col("term").alias("item"), "value", "rank")
    )


def distances(own: DataFrame, groups: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """lang, source, item (the other source) and value of each two sources of a language.

    With z the difference of a count of 0 on both sides, a term of both sources adds its
    difference, a term of one of them its difference from 0, all others add z. Put as
    z for all, corrections for the cells of each source, and corrections for the cells
    of both.
    """
    shared = own.join(groups.select("lang", "source", "terms", "total"), ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("terms"), rule).alias("p")
    )
    shared = stored(shared, "divergence-shares")
    one, other = (
        groups.select("lang", F.col("source").alias(s), F.col("p0").alias(f"{s}0"), *more)
        for s, more in (("a", ["terms"]), ("b", []))
    )
    z = F.abs(F.col("a0") - F.col("b0"))
    pairs = stored(one.join(other, "lang").filter("a < b").withColumn("z", z), "divergence-pairs")
    lone = shared.groupBy("lang", "source", "p").agg(F.count("*").alias("held"))
    lone = stored(lone, "divergence-lone")

    def corrected(side: str, far: str) -> DataFrame:
        return (
            pairs.join(lone.withColumnRenamed("source", side), ["lang", side])
            .select("lang", "a", "b", (F.col("held") * (F.abs(F.col("p") - F.col(f"{far}0")) - F.col("z"))).alias("v"))
        )

    left = shared.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"))
    right = shared.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"))
    both = (
        left.join(right, ["lang", "term"])
        .filter("a < b")
        .groupBy("lang", "a", "b", "pa", "pb")
        .agg(F.count("*").alias("held"))
        .join(pairs.select("lang", "a", "b", "a0", "b0", "z"), ["lang", "a", "b"])
        .select(
            "lang",
            "a",
            "b",
            (
                F.col("held")
                * (
                    F.abs(F.col("pa") - F.col("pb"))
                    - F.abs(F.col("pa") - F.col("b0"))
                    - F.abs(F.col("a0") - F.col("pb"))
                    + F.col("z")
                )
            ).alias("v"),
        )
    )
    base = pairs.select(
        "lang", "a", "b", F.when(F.col("terms") > 0, F.col("terms") * F.col("z")).otherwise(F.lit(0)).alias("v")
    )
    values = (
        base.union(corrected("a", "b")).union(corrected("b", "a")).union(both)
        .groupBy("lang", "a", "b")
        .agg(F.sum("v").alias("value"))
    )
    return values.select(
        "lang",
        F.explode(
            F.array(
                F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
            )
        ).alias("x"),
        "value",
    ).select("lang", "x.source", "x.item", "value")


@run("divergence")
def audit(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank, from 1 per group and part."""
    counted = stored(term_counts(documents), "divergence-terms")
    kept = stored(
        counted.groupBy("lang", "term")
        .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
        .filter(F.col("documents") >= rule.documents)
        .select("lang", "term", "n"),
        "divergence-kept",
    )
    own = stored(
        counted.join(kept.withColumnRenamed("n", "in_lang"), ["lang", "term"]).select(
            "lang", "source", "term", "n", "in_lang"
        ),
        "divergence-own",
    )
    drop(counted)
    groups = stored(_group_shares(documents, own, kept, rule), "divergence-groups")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = distances(own, groups, rule).withColumn("rank", F.row_number().over(by_value))
    named = lambda frame, part: frame.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")
    )
    return named(pairs, "pair").union(named(leading_terms(own, groups, rule), "term"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """``audit`` over the whole table ``documents``."""
    return audit(read_table(spark, folder, "documents"))


SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), t AS (
    SELECT r, lang, source,
           unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), langs AS (
    SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), own AS (
    SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
    SELECT DISTINCT lang, source FROM d
), totals AS (
    SELECT lang, source, coalesce(sum(n), 0) AS n FROM groups LEFT JOIN own USING (lang, source) GROUP BY ALL
), p AS (
    SELECT lang, source, term, coalesce(own.n, 0) AS n,
           1 + (1000000000 * (coalesce(own.n, 0) + 5)::HUGEINT) // (totals.n + 5 * v) AS p,
           1 + (1000000000 * (kept.n + 5)::HUGEINT) // (langs.n + 5 * v) AS q
    FROM totals JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), every AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= 50
"""
