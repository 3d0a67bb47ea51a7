"""Passages of op5 that only some rows of a cell share."""

from __future__ import annotations

import random

import numpy as np

from ledgerline.llm import compact_windows
from ledgerline.llm.compact_windows import repeats


def made(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def told(spark, docs):
    given = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    return {r.doc_id: r for r in repeats(given).collect()}


def test_every_occurrence_in_the_least_document(spark):
    """The least of two or three documents holds the passage three times."""
    shared = made(60, 1)
    least = made(30, 2) + shared + made(70, 3) + shared + made(80, 4) + shared + made(20, 5)
    for others in (1, 2):
        docs = [(1, least)] + [(2 + k, made(25, 10 + k) + shared + made(25, 20 + k)) for k in range(others)]
        got = told(spark, docs)[1]
        words = {k for s in got.spans for k in range(s.first, s.last)}
        assert all({*range(a, a + 60)} <= words for a in (30, 160, 300))
        assert got.n_repeat_words == len(words) < 3 * 60 + 3 * 30


def test_families_of_a_crowded_cell(spark, monkeypatch):
    """Thirty families share a phrase too short to be alike, and half of them a header.

    The two of a family share one word more on each side, which makes them alike. Their
    cells are mostly those of the phrase, which all families are in.
    """
    monkeypatch.setattr(compact_windows, "CROWD", 5, raising=False)
    phrase, header = made(44, 6), made(60, 7)
    docs, start = [(0, made(30, 8) + header + made(30, 9) + phrase + made(60, 30))], {}
    for family in range(30):
        left, right = made(2, 100 + family)
        for k in (1, 2):
            d = 10 * family + k
            before = made(20, 2000 + d) + header * (family < 15) + made(60, 4000 + d)
            start[d] = len(before)
            docs.append((d, before + [left] + phrase + [right] + made(60, 6000 + d)))
    got = told(spark, docs)
    found = {
        d for d, a in start.items()
        if {*range(a, a + 46)} <= {k for s in got[d].spans for k in range(s.first, s.last)}
    }
    assert len(found) >= 0.9 * len(start)
    assert all(got[d].class_id == (0 if d < 150 else 10 * (d // 10) + 1) for d in found)


def test_rows_of_cells_are_dealt_once(spark, monkeypatch):
    """Most cells have one row: they are neither stored nor dealt out a second time."""
    names, keep = [], compact_windows.stored
    monkeypatch.setattr(compact_windows, "stored", lambda frame, name: names.append(name) or keep(frame, name))
    shared = made(60, 1)
    got = told(spark, [(d, made(40, 10 + d) + shared + made(40, 20 + d)) for d in (1, 2, 3)])
    assert all(r.n_repeat_words >= 60 and r.class_id == 1 for r in got.values())
    assert "windows-shared" in names and "windows-cells" not in names


def test_a_phrase_of_many_texts_costs_no_comparison_of_all(spark, monkeypatch):
    """Sixty texts share a phrase, two of them a passage around it."""
    monkeypatch.setattr(compact_windows, "CROWD", 5)
    seen, keep = [], compact_windows._crowded

    def spy(around):
        pairs = keep(around)
        seen.append((around.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(compact_windows, "_crowded", spy)
    phrase, left, right = made(13, 1), made(20, 2), made(20, 3)
    docs = [(0, made(40, 8) + phrase + made(40, 9))]
    docs += [(d, made(40, 100 + d) + phrase + made(40, 200 + d)) for d in range(1, 58)]
    docs += [(d, made(30, 300 + d) + left + phrase + right + made(30, 400 + d)) for d in (58, 59)]
    got = told(spark, docs)
    (rows, pairs), = seen
    assert rows >= 20 and pairs < rows
    assert all(got[d].class_id == (58 if d >= 58 else d) for d in got)
    assert all({*range(30, 83)} <= {k for s in got[d].spans for k in range(s.first, s.last)} for d in (58, 59))


def test_alike_passages_share_a_rare_shingle():
    rng, width, alike = np.random.default_rng(5), compact_windows.WIDTH, 0
    for trial in range(300):
        n, few = int(rng.integers(width, 2 * width)), int(rng.choice([20, 10**6]))
        own = rng.integers(0, few, n)
        theirs = np.where(rng.random(n) < rng.choice([0.05, 0.1, 0.2]), rng.integers(0, few, n), own)
        often = np.arange(10**6) % 7
        near = compact_windows.alike(own.view(np.uint64), theirs.view(np.uint64))
        both = np.intersect1d(*(compact_windows.rarest(x, often[x]) for x in (own, theirs)))
        brute = []
        for i in range(n - width + 1):
            x, y = set(own[i : i + width].tolist()), set(theirs[i : i + width].tolist())
            brute.append(100 * len(x & y) >= compact_windows.PERCENT * len(x | y))
        assert near.tolist() == brute
        alike += any(brute)
        assert not any(brute) or len(both)
    assert 50 < alike < 300
