"""Runs, common lines and scratch tables: what the queries against SQL do not show."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import common, line_dedup, period_runs


def runs_by_trial(words):
    """start, length and period of all runs, by trying every period at every word."""
    found = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            n, s = j - i + q, words[i : j + q]
            if j > i and n >= max(6, 4 * q) and not any(q % d == 0 and s[d:] == s[:-d] for d in range(1, q)):
                found.add((i, n, q))
            i = max(j, i + 1)
    return sorted(found)


def some_words(pick):
    letters, words = pick.choice([1, 2, 3, 20]), []
    while len(words) < pick.choice([0, 3, 8, 30, 120, 300]):
        part = [pick.randrange(letters) for _ in range(pick.randrange(1, 20))]
        again = pick.choice([1, pick.randrange(1, 9)])
        words += part * again + part[: pick.randrange(len(part) + 1)]
    return words


@pytest.mark.parametrize(("words", "boundaries"), [(4096, 8), (8, 2), (1, 1)])
def test_runs_for_any_tiles(spark, monkeypatch, words, boundaries):
    monkeypatch.setattr(period_runs, "TILE_WORDS", words)
    monkeypatch.setattr(period_runs, "TILE_BOUNDARIES", boundaries)
    pick = random.Random(words)
    texts = [some_words(pick) for _ in range(400)]
    rows = []
    for k in range(0, len(texts), 5):
        offsets = np.append(0, np.cumsum([len(t) for t in texts[k : k + 5]]))
        ids = np.array([x for t in texts[k : k + 5] for x in t], np.int64)
        for found in period_runs.fragments(offsets, ids):
            rows += [(k + t, 0, *f) for t, *f in zip(*(v.tolist() for v in found), strict=True)]
    made = period_runs.stitched(
        spark.createDataFrame(rows, "doc_id bigint, mark bigint, period bigint, start bigint, end bigint")
    ).collect()
    got = sorted((r.doc_id, r.start, r.length, r.period) for r in made)
    assert got == sorted((d, *r) for d, t in enumerate(texts) for r in runs_by_trial(t))


def test_collapsed_texts(spark):
    texts = ["a b " * 5 + "c", "x", None, "  y  z ", "q " * 20_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in period_runs.find_runs(frame).collect()}
    assert found[0] == ("a b c", [(0, 2, 10)])
    assert found[4] == ("q", [(0, 1, 20_000)])
    assert [found[i] for i in (1, 2, 3)] == [(None, [])] * 3


def test_lines_dropped_in_place(spark):
    line = "a line of twenty and more characters"
    frame = spark.createDataFrame(
        [(1, f"one\n {line} \n", "k", 1), (2, f"{line}\ntwo", "k", 2), (3, f"{line.upper()}\n\n{line}", "k", 3), (4, None, "k", 4)],
        "doc_id int, text string, mark string, gone int",
    )
    rows = {r.doc_id: r for r in line_dedup.drop_lines(frame).collect()}
    assert {d: r.text for d, r in rows.items()} == {1: "one\n", 2: "two", 3: f"{line.upper()}\n\n{line}", 4: None}
    assert {d: (r.n_lines, r.n_dropped) for d, r in rows.items()} == {1: (3, 1), 2: (2, 1), 3: (3, 0), 4: (1, 0)}
    assert all(r.mark == "k" and r.gone == d for d, r in rows.items())
    with pytest.raises(ValueError, match="n_lines"):
        line_dedup.drop_lines(frame.withColumn("n_lines", F.lit(1)))


def test_line_plan_has_no_python(spark):
    frame = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    plan = line_dedup.drop_lines(frame)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def files(spark):
    place = common.shared_folder(spark).removeprefix("file:")
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def test_a_run_keeps_its_result_only(spark):
    @common.run("scratch-inner")
    def inner():
        return common.stored(spark.range(3), "scratch-a")

    @common.run("scratch-outer")
    def outer():
        first = inner()
        second = common.stored(first.union(first), "scratch-b")
        common.drop(first)
        return second

    before = files(spark)
    result = outer()
    (left,) = files(spark) - before
    assert left.startswith("scratch-outer") and result.count() == 6


def test_a_failed_run_leaves_nothing(spark):
    @common.run("scratch-failed")
    def failing():
        common.stored(spark.range(3), "scratch-c")
        return spark.range(3).select(F.raise_error(F.lit("on purpose")))

    before = files(spark)
    with pytest.raises(Exception, match="on purpose"):
        failing()
    assert files(spark) == before


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())
