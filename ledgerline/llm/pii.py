r"""PII: fixed kinds by expression, and bootstrapped contextual extraction.

The fixed kinds (email, ip, card, phone) are found by expression. They, and values
shaped like keys, are the seed entities. The words around each place where a value
with a digit or an ``@`` stands are its lexical patterns, at several widths: the word
before it, the two words before it, the word on either side, and a name with its
connector (``password=``, ``token = "``). Patterns and the instances that stand in
them form a graph; scores go back and forth on it: a pattern is worth the share of its
occurrences that a trusted instance fills, an instance is worth as much as the best
pattern that it fills. Patterns with a high score then discover identifiers that no
expression knows, as spans of kind ``id``.

All of it is DataFrame expressions. The texts are read once. Spans of one text are put
together from blocks of about the square root of their number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import let, run, salted, sifted, stored, text_of
from ledgerline.sources import read_table

KINDS = ["email", "ip", "card", "phone"]
FOUND = "id"

#: The kinds' expressions. Possessive repeats and the look-behinds only keep a search
#: in a long run of like characters from starting again at each of them; the matches
#: are those of the plain expressions.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: What may be an instance: runs like a phone or a card number, and words that hold a
#: digit or an ``@``.
UNIT = (
    r"\+[0-9][\x20().0-9-]*[0-9]"
    r"|(?<![A-Za-z0-9@._%+-])[0-9](?:[\x20-]?[0-9]){13,}+"
    r"|(?<![A-Za-z0-9@._%+-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9@._%+-]*+"
)
#: Patterns are read off so many characters before and after a value.
CONTEXT = 48
#: A word of the context, and what may stand between it and the value.
WORD = r"\S*\p{L}{2}\S*"
OPENING = r"[\s\"'(<\[]*$"
CUE = r"[A-Za-z_]{2,}\x20?[=:#]\x20?[\"']?$"
NEXT = r"^[\"')>\].,;:]*\s+(" + WORD + ")"
#: Values shaped like keys, which are seeds too, and what may be discovered at all.
KEY_SHAPE = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{12,}$"
IDENTIFIER = r"^(?=.*[0-9])[A-Za-z0-9@._+-]{6,}$"

ROUNDS = 3
#: A pattern is trusted when so large a share of its occurrences leads to trusted
#: instances, and so many different ones.
PATTERN_SCORE = 0.7
PATTERN_INSTANCES = 3

_SPANS = "array<struct<start:int,end:int,value:string>>"
_UNITS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def blocks(values: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(block, index of its first value)`` of each block of an array.

    A block has about the square root of the array's values. An empty array has one
    empty block.
    """
    width = lambda n: F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    return let(
        width(F.size(values)),
        lambda w: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), w),
            lambda at: body(F.slice(values, at + 1, w), at),
        ),
    )


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each int of an array, ``join`` (which must be associative) of all up to it.

    An array that grows by one is copied each time, so this goes by blocks, and then
    over the blocks.
    """
    last = lambda a: F.get(a, F.size(a) - 1)
    scan = lambda block: F.aggregate(
        block,
        F.array().cast("array<int>"),
        lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(join(last(acc), x)))),
    )
    return let(
        blocks(values, lambda block, at: scan(block)),
        lambda inner: let(
            scan(F.transform(inner, last)),
            lambda outer: F.flatten(
                F.transform(
                    inner,
                    lambda block, i: F.transform(
                        block, lambda x: F.when(i == 0, x).otherwise(join(F.get(outer, i - 1), x))
                    ),
                )
            ),
        ),
    )


def matches(text: Column, pattern: str, around: int = 0) -> Column:
    """Array of (start, end, value) of the leftmost matches, in code points, end exclusive.

    With ``around`` also before and after: so many characters on either side at most,
    but none of the matches next to it.
    """

    def of(found: Column, gaps: Column, ends: Column) -> Column:
        def span(value: Column, i: Column) -> Column:
            end = F.get(ends, i)
            more = [
                F.right(F.get(gaps, i), F.lit(around)).alias("before"),
                F.left(F.get(gaps, i + 1), F.lit(around)).alias("after"),
            ]
            return F.struct(
                (end - F.length(value)).alias("start"),
                end.alias("end"),
                value.alias("value"),
                *(more if around else []),
            )

        return F.transform(found, span)

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: let(
            F.split(text, pattern, -1),
            lambda gaps: let(
                running(
                    F.transform(found, lambda value, i: F.length(F.get(gaps, i)) + F.length(value)),
                    lambda a, b: a + b,
                ),
                lambda ends: of(found, gaps, ends),
            ),
        ),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    return F.forall(
        F.split(value, r"\."),
        lambda part: let(
            F.regexp_replace(part, "^0+", ""),
            lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")),
        ),
    )


def _is_card(value: Column) -> Column:
    doubled = lambda d, i: F.when(
        i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    ).otherwise(d)
    total = lambda digits: F.aggregate(
        F.transform(
            F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)),
            lambda c, i: doubled(c.cast("int"), i),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    return let(
        _digits(value),
        lambda d: F.when(F.length(d).between(14, 19), total(d) % 10 == 0).otherwise(F.lit(False)),
    )


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


#: For each kind: what a text must hold to be searched, the expression, the test of a match.
RULES = {
    "email": (lambda t: F.contains(t, F.lit("@")), EMAIL, None),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), IP, _is_ip),
    "card": (lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), CARD, _is_card),
    "phone": (lambda t: F.contains(t, F.lit("+")), PHONE, _is_phone),
}


def _passing(spans: Column, test: Callable[[Column], Column] | None) -> Column:
    return spans if test is None else F.filter(spans, lambda s: test(s["value"]))


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["value"].alias("value")
        ),
    )


def base_spans(text: Column) -> Column:
    """Array of (start, rank of the kind, end, value), by start and kind."""
    found = []
    for rank, kind in enumerate(KINDS):
        worth, pattern, test = RULES[kind]
        spans = F.when(worth(text), matches(text, pattern)).otherwise(F.array().cast(_SPANS))
        found.append(_ranked(_passing(spans, test), rank))
    return F.sort_array(F.concat(*found))


def units(text: Column) -> Column:
    """Array of (start, end, value, before, after) of what may be an instance."""
    return F.when(text.rlike("[0-9@]"), matches(text, UNIT, CONTEXT)).otherwise(F.array().cast(_UNITS))


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, base spans and units of each row, in the shared folder.

    A null or empty text has neither.
    """
    text = F.col("text")
    return stored(
        documents.select("doc_id", text_of().alias("text")).select(
            "doc_id", text_key(text).alias("text_key"), base_spans(text).alias("base"), units(text).alias("units")
        ),
        "pii",
    )


def is_seed(value: Column) -> Column:
    """Whether a value holds an entity of a fixed kind, or is shaped like a key."""
    held = [F.size(_passing(matches(value, pattern), test)) > 0 for _, pattern, test in RULES.values()]
    return reduce(lambda a, b: a | b, held) | value.rlike(KEY_SHAPE)


def patterns_of(before: Column, after: Column) -> Column:
    """The patterns of a place, in lower case, with ``_`` where the value stands.

    Each is there only if the words that it needs are.
    """
    one = F.regexp_extract(before, f"({WORD}){OPENING}", 1)
    two = F.regexp_extract(before, rf"(\S+\s+{WORD}){OPENING}", 1)
    cue = F.regexp_extract(before, CUE, 0)
    right = F.regexp_extract(after, NEXT, 1)
    where = lambda needed, pattern: F.when(
        reduce(lambda a, b: a & b, [n != "" for n in needed]), F.lower(F.concat(*pattern))
    )
    return F.array_distinct(
        F.array_compact(
            F.array(
                where([cue], [cue, F.lit("_")]),
                where([one], [one, F.lit(" _")]),
                where([two], [F.regexp_replace(two, r"\s+", " "), F.lit(" _")]),
                where([one, right], [one, F.lit(" _ "), right]),
            )
        )
    )


def occurrences(scanned: DataFrame) -> DataFrame:
    """Each place as doc_id, text_key, patterns, instance, start and end.

    Places without a pattern are left out.
    """
    unit = F.col("unit")
    return (
        scanned.select("doc_id", "text_key", F.explode("units").alias("unit"))
        .select(
            "doc_id",
            "text_key",
            patterns_of(unit["before"], unit["after"]).alias("patterns"),
            F.regexp_replace(unit["value"], r"[._%+@-]+$", "").alias("instance"),
            unit["start"].alias("start"),
        )
        .filter((F.size("patterns") > 0) & (F.col("instance") != ""))
        .withColumn("end", F.col("start") + F.length("instance"))
    )


def trusted_patterns(
    found: DataFrame, rounds: int = ROUNDS, least: float = PATTERN_SCORE, different: int = PATTERN_INSTANCES
) -> DataFrame:
    """The patterns of ``occurrences`` that lead to identifiers, with their score.

    The graph has an edge for each pattern and instance, with its occurrences; those
    of a hot pattern or instance are added up before they are sent anywhere. Patterns
    with fewer than ``different`` instances can never be trusted and go at once. Each
    round scores the patterns from the instances and the instances from the patterns;
    a seed stays trusted, and other instances are trusted as their best pattern is.
    """
    edges = stored(
        found.select(F.explode("patterns").alias("pattern"), "instance")
        .groupBy("pattern", "instance")
        .agg(F.count("*").alias("n")),
        "pii-edges",
    )
    broad = edges.groupBy("pattern").agg(F.count("*").alias("held")).filter(F.col("held") >= different)
    edges = stored(
        salted(edges, broad.select("pattern"), ["pattern"], "instance")
        .withColumn("seed", is_seed(F.col("instance")).cast("double"))
        .withColumn("identifier", F.col("instance").rlike(IDENTIFIER)),
        "pii-graph",
    )
    led, trusted = None, None
    for _ in range(rounds):
        valued = edges.withColumn("led", F.lit(0.0)) if led is None else salted(
            edges, led, ["instance"], "pattern", "left"
        )
        trust = F.greatest("seed", F.coalesce("led", F.lit(0.0)))
        trusted = stored(
            valued.groupBy("pattern")
            .agg(
                (F.sum(F.col("n") * trust) / (F.sum("n") + 1)).alias("score"),
                F.sum((trust >= least).cast("bigint")).alias("instances"),
            )
            .filter((F.col("score") >= least) & (F.col("instances") >= different))
            .select("pattern", "score"),
            "pii-patterns",
        )
        led = (
            salted(edges.filter("identifier"), trusted, ["pattern"], "instance")
            .groupBy("instance")
            .agg(F.max("score").alias("led"))
        )
    return trusted


def discovered(scanned: DataFrame, found: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, text_key and the array of (start, rank, end) that trusted patterns lead to.

    Only what looks like an identifier and touches no span of a fixed kind. Rows of a
    document given twice have their spans once.
    """
    who = ["doc_id", "text_key"]
    led = stored(
        salted(
            found.filter(F.col("instance").rlike(IDENTIFIER)).withColumn("pattern", F.explode("patterns")),
            patterns.select("pattern"),
            ["pattern"],
            "text_key",
        )
        .select(*who, "start", F.lit(len(KINDS)).alias("rank"), "end")
        .distinct(),
        "pii-led",
    )
    ids = led.select(*[F.col(c).alias(f"led_{c}") for c in who]).distinct()
    base = (
        scanned.filter(F.size("base") > 0)
        .join(
            ids,
            F.col("doc_id").eqNullSafe(F.col("led_doc_id")) & (F.col("text_key") == F.col("led_text_key")),
            "left_semi",
        )
        .select(*who, F.explode("base").alias("span"))
        .select(*who, "span.start", "span.rank", "span.end")
        .distinct()
    )
    fixed = F.col("rank") < len(KINDS)
    along = Window.partitionBy(*who).orderBy("start", "rank", "end")
    before = F.max(F.when(fixed, F.col("end"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    # upwards, so that this too is a running value
    back = Window.partitionBy(*who).orderBy(F.desc("start"), F.desc("rank"), F.desc("end"))
    after = F.min(F.when(fixed, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    return (
        led.unionByName(base)
        .withColumn("before", before)
        .withColumn("after", after)
        .filter(
            ~fixed
            & (F.coalesce("before", F.lit(0)) <= F.col("start"))
            & (F.coalesce("after", F.col("end")) >= F.col("end"))
        )
        .groupBy(*who)
        .agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias("more"))
    )


def find(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, base and spans (arrays of start, rank, end) of each row."""
    scanned = scan(documents)
    found = stored(occurrences(scanned), "pii-places")
    more = discovered(scanned, found, trusted_patterns(found)).select(
        F.col("doc_id").alias("more_id"), F.col("text_key").alias("more_key"), "more"
    )
    plain = F.transform("base", lambda s: F.struct(s["start"], s["rank"], s["end"]))
    return (
        scanned.select("doc_id", "text_key", plain.alias("base"))
        .join(
            more,
            F.col("doc_id").eqNullSafe(F.col("more_id")) & (F.col("text_key") == F.col("more_key")),
            "left",
        )
        .select(
            "doc_id",
            "text_key",
            "base",
            F.when(F.col("more").isNull(), F.col("base"))
            .otherwise(F.sort_array(F.concat("base", "more")))
            .alias("spans"),
        )
    )


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in [*KINDS, FOUND]])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])
        ),
        ",",
    )


@run("pii-spans")
def spans_of(documents: DataFrame) -> DataFrame:
    """doc_id, text_key and spans of the texts that have any."""
    found = find(documents.select("doc_id", "text")).filter(F.size("spans") > 0)
    return found.groupBy("doc_id", "text_key").agg(F.first("spans").alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with each span replaced by its kind in angle brackets.

    Spans that touch or overlap are replaced as one, under the kind of the first.
    ``n_chars``, where there is one, follows the text. All else stays, null texts too.
    """
    names = F.array(*[F.lit(f"<{k}>") for k in [*KINDS, FOUND]])
    hits = spans_of(documents)
    row = F.col("row")
    text = row["text"]
    up_to = lambda covered, i: F.when(i == 0, F.lit(0)).otherwise(F.get(covered, i - 1))

    def piece(section: Column, first: Column, at: Column, s: Column) -> Column:
        """What stands before a span, and its kind; empty for one inside those before it."""
        kept = F.substring(section, at - first + 1, s["start"] - at)
        return F.when(s["start"] < at, F.lit("")).otherwise(F.concat(kept, F.get(names, s["rank"])))

    def block(covered: Column, spans: Column, at: Column) -> Column:
        first = up_to(covered, at)
        end = F.get(covered, at + F.size(spans) - 1)
        return let(
            F.substring(text, first + 1, end - first),
            lambda section: F.array_join(
                F.transform(spans, lambda s, i: piece(section, first, up_to(covered, at + i), s)), ""
            ),
        )

    clean = let(
        running(F.transform("spans", lambda s: s["end"]), F.greatest),
        lambda covered: F.concat(
            F.array_join(blocks(F.col("spans"), lambda spans, at: block(covered, spans, at)), ""),
            F.substring(text, F.get(covered, F.size(covered) - 1) + 1, F.length(text)),
        ),
    )
    # most texts have no span, and stay where they are
    found, plain = sifted(documents.select(F.struct("*").alias("row")), hits, row["doc_id"], F.col("doc_id"))
    none = F.lit(None).cast(hits.schema["spans"].dataType)
    joined_rows = (
        found.join(
            hits.toDF("hit_id", "hit_key", "spans"),
            row["doc_id"].eqNullSafe(F.col("hit_id")) & (text_key(F.coalesce(text, F.lit(""))) == F.col("hit_key")),
            "left",
        )
        .select("row", "spans")
        .withColumn("clean", F.when(F.col("spans").isNull(), text).otherwise(clean))
        .union(plain.select("row", none.alias("spans"), text.alias("clean")))
    )

    def of(name: str) -> Column:
        if name == "text":
            return F.col("clean")
        if name == "n_chars":
            counted = F.length("clean").cast(documents.schema[name].dataType)
            return F.when(F.col("spans").isNull(), row[name]).otherwise(counted)
        return row.getField(name)

    return joined_rows.select([of(c).alias(c) for c in documents.columns])


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    """The spans of every document."""
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("bigint")
    return find(read_table(spark, folder, "documents")).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        (F.size("spans") > 0).alias("has_pii"),
    )
