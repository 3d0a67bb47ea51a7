"""What keeps texts and sets out of a shuffle loses no match."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import pii
from ledgerline.llm.common import sifted
from ledgerline.llm.jaccard_join import MOST_GROUPS, Rule, least_difference, parity, verified


def test_sifted_keeps_every_match_and_few_others(spark):
    many = spark.createDataFrame([(i,) for i in range(20_000)] + [(None,), (7,)], "k bigint")
    few = spark.createDataFrame([(i,) for i in range(0, 400, 2)] + [(None,), (7,), (7,)], "x bigint")
    may, others = ([r.k for r in rows.collect()] for rows in sifted(many, few, F.col("k"), F.col("x")))
    wanted = {*range(0, 400, 2), 7, None}
    assert not wanted & set(others)
    assert sorted(may + others, key=str) == sorted([*range(20_000), None, 7], key=str)
    assert len(may) < 300
    none, whole = sifted(many, few.limit(0), F.col("k"), F.col("x"))
    assert (none.count(), whole.count()) == (0, 20_002)


@pytest.mark.parametrize("sizes", [(1, 1, 1), (3, 4, 2), (40, 60, 30), (900, 1100, 870), (MOST_GROUPS, 70_000, 60_000)])
def test_parities_differ_in_no_more_groups_than_the_sets(sizes):
    n, m, both = sizes
    pool = np.unique(np.random.default_rng(5).integers(0, 2**64, n + m - both, dtype=np.uint64))
    one, other = pool[:n], pool[n - both :]
    least = least_difference(parity(one), parity(other))
    assert least == least_difference(parity(other), parity(one))
    assert 0 <= least <= len(np.setxor1d(one, other))
    assert least_difference(parity(one), parity(one)) == 0


def test_verified_pairs_are_those_of_brute_force(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {
        1: words[:300],
        2: words[:300] + ["end"],
        3: words[20:300],
        4: words[60:360],
        5: words[:5],
        6: words[:6],
        7: words[100:],
    }
    rule = Rule(4, 85)
    sets = {k: {tuple(t[i : i + 4]) for i in range(len(t) - 3)} for k, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b]
    linked = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert linked and len(linked) < len(pairs)
    rows = [(k, " ".join(t)) for k, t in texts.items()] + [(i, f"text {i}") for i in range(50, 300)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = verified(spark.createDataFrame(pairs, "a bigint, b bigint"), documents, rule)
    assert {tuple(r) for r in found.collect()} == linked


def test_texts_without_a_match_are_not_dealt_out(spark):
    """Of 4,000 texts with three hits, few rows go through the shuffle of the join."""
    rows = [(i, "mail a@b.co now" if i % 1500 == 3 else f"text {i}", 9) for i in range(4000)]
    rows += [(None, "mail a@b.co now", 9), (None, None, None)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars int")
    out = {(r.doc_id, r.text, r.n_chars) for r in pii.redact(documents).collect()}
    clean = "mail <email> now"
    assert out == {
        (i, clean, len(clean)) if t and "@" in t else (i, t, n) for i, t, n in rows
    }
    hits = spark.createDataFrame([(3,), (1503,), (3003,), (None,)], "doc_id bigint")
    may, _ = sifted(documents, hits, F.col("doc_id"), hits["doc_id"])
    assert 5 <= may.count() < 20
