"""URL filters: gradient-boosted trees on lexical features of the URL.

The features are lengths, path depth, digit ratio, character entropy, parameter
counts and statistics of the host's suffix. The trees are trained from labelled
URLs; listed rules come first where one fits. A labelled URL never sees the labels of
its own fold of hosts in its features, and ``held_out`` measures the trees on hosts
that they have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, salted, stored
from ledgerline.sources import read_table

#: (verdict, host, path). Fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: The trees are fitted on about this many labelled URLs at most.
TRAINING_URLS = 20_000
TREES = 10
DEPTH = 4
SEED = 7
#: URLs are blocked from the score on at which so large a share of unseen ones is labelled so.
PRECISION = 0.8
#: Hosts are put into so many folds.
FOLDS = 5
#: The rate of blocks of a suffix is drawn to that of all URLs as if by so many more URLs.
PRIOR_URLS = 20

FEATURES = [
    "url_chars",
    "host_chars",
    "path_chars",
    "host_labels",
    "depth",
    "digit_ratio",
    "host_digit_ratio",
    "entropy",
    "hyphens",
    "parameters",
    "query_chars",
    "has_fragment",
    "is_secure",
    "suffix_log_urls",
    "suffix_block_rate",
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``.

    The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, A-Z in lower case. The path follows, up to ``?``, ``#`` or the end.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null where none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        chosen = F.when(
            fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(chosen)
    return chosen


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, ...) with the features that need the URL alone."""
    url = F.coalesce(F.col("url"), F.lit(""))
    plain = ascii_lower(url)
    chars = F.length(plain)
    without = lambda c, of: F.length(of) - F.length(F.translate(of, c, ""))
    counts = [without(c, plain) for c in "abcdefghijklmnopqrstuvwxyz0123456789-._~/?#=&%:"]
    counts.append(chars - reduce(lambda a, b: a + b, counts))
    n = F.greatest(chars, F.lit(1))
    entropy = reduce(
        lambda a, b: a + b,
        [F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(F.lit(0.0)) for c in counts],
    )
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    host, path = F.col("host"), F.col("path")
    return urls.select(
        "*",
        F.regexp_extract(host, r"[^.]*$", 0).alias("suffix"),
        chars.cast("double").alias("url_chars"),
        F.length(host).cast("double").alias("host_chars"),
        F.length(path).cast("double").alias("path_chars"),
        (without(".", host) + 1).cast("double").alias("host_labels"),
        without("/", path).cast("double").alias("depth"),
        (without("0123456789", plain) / n).alias("digit_ratio"),
        (without("0123456789", host) / F.greatest(F.length(host), F.lit(1))).alias("host_digit_ratio"),
        entropy.alias("entropy"),
        without("-", plain).cast("double").alias("hyphens"),
        F.when(query == "", F.lit(0.0)).otherwise((without("&", query) + 1).cast("double")).alias("parameters"),
        F.length(query).cast("double").alias("query_chars"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        plain.startswith("https://").cast("double").alias("is_secure"),
    )


def fold_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def with_suffix_statistics(urls: DataFrame) -> DataFrame:
    """``urls`` with the log of the URLs of each host suffix, and its rate of blocks.

    ``urls`` has url, host, suffix and label (1 block, 0 allow, null without one). All
    rows count. The rate is that of the suffix over the labels of the other folds for a
    URL with a label, and over all labels for one without. It is drawn to the rate of
    the whole table (0.5 if nothing has a label). A suffix sends one row for each task
    and fold, however many URLs have it.
    """
    urls = urls.withColumn("fold", fold_of(F.col("host")))
    counts = urls.groupBy("suffix", "fold").agg(
        F.count("*").alias("n"),
        F.count("label").alias("known"),
        F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocks"),
    )
    known, blocks = counts.agg(F.sum("known"), F.sum("blocks")).first()
    usual = blocks / known if known else 0.5
    rate = lambda blocks, known: (blocks + PRIOR_URLS * usual) / (known + PRIOR_URLS)
    each = counts.groupBy("suffix").agg(
        F.sum("n").alias("n"),
        F.sum("known").alias("known"),
        F.sum("blocks").alias("blocks"),
        F.collect_list(F.struct("fold", "known", "blocks")).alias("folds"),  # FOLDS at most
    )
    statistics = each.select(
        "suffix",
        F.log1p("n").alias("suffix_log_urls"),
        rate(F.col("blocks"), F.col("known")).alias("all_rate"),
        "known",
        "blocks",
        F.explode("folds").alias("own"),
    ).select(
        "suffix",
        F.col("own.fold").alias("fold"),
        "suffix_log_urls",
        "all_rate",
        rate(F.col("blocks") - F.col("own.blocks"), F.col("known") - F.col("own.known")).alias("other_rate"),
    )
    return (
        salted(urls, statistics, ["suffix", "fold"], "url")
        .withColumn(
            "suffix_block_rate",
            F.when(F.col("label").isNull(), F.col("all_rate")).otherwise(F.col("other_rate")),
        )
        .drop("all_rate", "other_rate")
    )


@dataclass
class UrlModel:
    """Fitted trees; ``trees`` is None where the labels hold one class or none."""

    trees: GBTClassificationModel | None
    only: float

    def score(self, features: DataFrame) -> DataFrame:
        """``features`` with ``score``, the probability of a block."""
        if self.trees is None:
            return features.withColumn("score", F.lit(self.only))
        ready = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(features)
        return (
            self.trees.transform(ready)
            .withColumn("score", vector_to_array("probability")[1])
            .drop("__features", "rawPrediction", "probability", "prediction")
        )


def fit(features: DataFrame, at_most: int = TRAINING_URLS) -> UrlModel:
    """Trees for the rows of ``features`` with a label.

    Of more than ``at_most`` labelled rows, those with the least hash of the URL
    are taken, about ``at_most`` of them; which ones does not depend on the order
    or number of partitions. Without rows of both labels the score is constant:
    0.5 without any label.
    """
    labelled = features.filter(F.col("label").isNotNull())
    rows, blocks = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < blocks < rows:
        return UrlModel(None, 0.5 if not rows else float(blocks > 0))
    grain = 1_000_000
    share = min(grain, int(grain * at_most / rows) + 1)
    sample = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(grain)) < share)
    ready = (
        VectorAssembler(inputCols=FEATURES, outputCol="__features")
        .transform(sample)
        .select("__features", "label", F.xxhash64("url").alias("order"))
        .repartition(4, "order")
        .sortWithinPartitions("order")
        .select("__features", "label")
    )
    if ready.select("label").distinct().count() < 2:
        return UrlModel(None, blocks / rows)
    trees = GBTClassifier(featuresCol="__features", maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32)
    return UrlModel(trees.fit(ready), 0.0)


def featured(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None
) -> DataFrame:
    """page_id, url, host, path, fit (rule and verdict), label, fold and the features.

    Labels are the verdicts of the rules, block as 1 and allow as 0. With ``labels``
    (url, label as 1.0 or 0.0, each url once) they are those instead.
    """
    host, path = parts(F.col("url"))
    urls = (
        pages.select("page_id", "url")
        .select("page_id", "url", host.alias("host"), path.alias("path"))
        .withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    )
    if labels is None:
        ruled = F.when(F.col("fit.verdict") == "block", 1.0).when(F.col("fit.verdict") == "allow", 0.0)
        urls = urls.withColumn("label", ruled)
    else:
        urls = salted(urls, labels.select("url", "label"), ["url"], "page_id", "left")
    return with_suffix_statistics(lexical(urls))


def held_out(features: DataFrame, at_most: int = TRAINING_URLS) -> dict[str, float]:
    """How the trees do on the labelled URLs of fold 0, having learned from the others.

    ``urls`` is their number, ``accuracy`` the share judged right, ``usual`` the share
    that the more frequent label of these URLs has, ``blocked`` the share blocked. The
    rates of the suffixes come from the other folds here too.
    """
    model = fit(features.filter(F.col("fold") != 0), at_most)
    tested = model.score(features.filter((F.col("fold") == 0) & F.col("label").isNotNull()))
    block = (F.col("score") >= 0.5).cast("double")
    n, accuracy, blocked, labelled = tested.agg(
        F.count("*"), F.avg((block == F.col("label")).cast("double")), F.avg(block), F.avg("label")
    ).first()
    if not n:
        return {"urls": 0, "accuracy": 0.0, "usual": 0.0, "blocked": 0.0}
    return {"urls": n, "accuracy": accuracy, "usual": max(labelled, 1 - labelled), "blocked": blocked}


def least_score(features: DataFrame, precision: float = PRECISION, at_most: int = TRAINING_URLS) -> float:
    """From which score of the trees on a URL is blocked, in hundredths, 0.5 at least.

    Trees that have learned from the other folds score the labelled URLs of fold 0; of
    those with the least score or more, ``precision`` must be blocks. Where no score
    tells blocks that well, 2.0: the trees then block nothing.
    """
    scored = fit(features.filter(F.col("fold") != 0), at_most).score(
        features.filter((F.col("fold") == 0) & F.col("label").isNotNull())
    )
    bins = (
        scored.groupBy(F.floor(F.col("score") * 100).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"), F.sum("label").alias("blocks"))
        .collect()  # 101 rows at most
    )
    least, n, blocks = 2.0, 0, 0.0
    for row in sorted(bins, key=lambda r: -r.bin):
        n, blocks = n + row.n, blocks + row.blocks
        if row.bin >= 50 and blocks / (n + 1) >= precision:
            least = row.bin / 100
    return least


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labels: DataFrame | None = None
) -> DataFrame:
    """page_id, host, path, rule, verdict and score of each row of ``pages``.

    The verdict is the rule's; without one it is block from the score of the trees on
    that ``least_score`` gives, else allow (so also in a table without any labelled URL,
    null URLs included). The trees learn from the URLs that a rule fits, or from
    ``labels``, see ``featured``.
    """
    features = stored(featured(pages, rules, labels), "url-features")
    scored = fit(features).score(features)
    least = least_score(features)
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(
            F.col("fit.verdict"), F.when(F.col("score") >= least, "block").otherwise("allow")
        ).alias("verdict"),
        "score",
    )


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """``judge`` over every row of ``pages``."""
    return judge(read_table(spark, folder, "pages"))
