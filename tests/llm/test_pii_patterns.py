"""Patterns that are induced from the contexts of seeds, and spans of crowded texts."""

from __future__ import annotations

import re

import pytest

from ledgerline.llm import pii

SCHEMA = "doc_id bigint, text string"


def spans(spark, texts):
    rows = pii.find(spark.createDataFrame(texts, SCHEMA)).select(
        "doc_id", pii.joined(pii.F.col("spans")).alias("spans")
    )
    return {r.doc_id: set(filter(None, r.spans.split(","))) for r in rows.collect()}


def at(text, value):
    return f"id:{text.index(value)}:{text.index(value) + len(value)}"


def test_seeds_induce_patterns_in_prose(spark):
    """E-mails teach 'reach me under', which finds names; these teach 'passport number'."""
    mails = [(i, f"one said reach me under a{i}@b{i}.org today") for i in range(40)]
    names = [(100 + i, f"and they reach me under jdoe-{44 + i}1 now") for i in range(12)]
    passports = [(200 + i, f"her passport number jdoe-{44 + i}1 was seen") for i in range(12)]
    unseen = [(300, "his passport number XK90871234 was lost"), (301, "page 123456789 of it")]
    texts = [*mails, *names, *passports, *unseen, (400, None), (None, "reach me under null-id-77")]
    found = spans(spark, texts)
    for i, text in names + passports:
        assert found[i] == {at(text, f"jdoe-{44 + i % 100}1")}
    assert found[300] == {at(unseen[0][1], "XK90871234")}
    assert found[301] == found[400] == set()
    assert found[None] == {at("reach me under null-id-77", "null-id-77")}


def test_patterns_of_mixed_worth_are_not_trusted(spark):
    seeds = [(i, f"look at a{i}@b{i}.org now") for i in range(10)]
    others = [(100 + i, f"look at chapter{i}000 now") for i in range(10)]
    found = spans(spark, seeds + others)
    assert all(found[i] == set() for i, _ in others)


def test_discovered_spans_touch_no_fixed_span(spark):
    keys = [(i, f'token = "{i:02x}deadbeef{i:02x}77"') for i in range(1, 8)]
    text = 'token = "ZZ90-11.22" and +1 (555) 010-9999, token = "mail7@b.co"'
    found = spans(spark, [*keys, (100, text)])
    assert {s for s in found[100] if s.startswith("id")} == {at(text, "ZZ90-11.22")}
    assert len(found[100]) == 3


@pytest.mark.parametrize("count", [0, 1, 2, 3, 50, 20_000])
def test_many_spans_of_one_text(spark, count):
    """The spans and the redaction of a text with very many entities, as plain Python has them."""
    text = "é " + " ".join(f"w{i % 7} a{i}@b.co," for i in range(count)) + " end"
    frame = spark.createDataFrame([(1, text), (2, None)], SCHEMA)
    row = {r.doc_id: r.text for r in pii.redact(frame).collect()}
    mail = r"[a-z0-9]+@b\.co"
    assert row == {1: re.sub(mail, "<email>", text), 2: None}
    found = frame.select("doc_id", pii.base_spans(pii.text_of()).alias("s")).collect()
    assert [(s.start, s.end) for s in found[0].s] == [m.span() for m in re.finditer(mail, text)]
