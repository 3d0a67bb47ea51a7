"""Runs of alike passages, of many pairs at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ledgerline.llm import compact_windows
from ledgerline.llm.compact_windows import PASSAGE, WIDTH, alike, near_runs


def pairs(count: int, repeats: bool):
    pick = np.random.default_rng(11)
    hashes = lambda n: pick.integers(0, 2**63, n).astype(np.uint64)
    for _ in range(count):
        n = int(pick.choice([0, 20, WIDTH, WIDTH + 1, 60, 91, 91, 91, 300]))
        own = hashes(n)
        theirs = np.concatenate([own, hashes(int(pick.integers(0, 5)))])[int(pick.integers(0, 3)) :]
        changed = pick.random(len(theirs)) < pick.choice([0, 0.05, 0.2])
        theirs[changed] = hashes(int(changed.sum()))
        if repeats and n > 10 and pick.random() < 0.3:
            own[3] = own[7]
        yield own, theirs


def test_runs_are_those_of_each_pair():
    own, theirs = zip(*pairs(600, repeats=True), strict=True)
    wanted = set()
    for k, (x, y) in enumerate(zip(own, theirs, strict=True)):
        edges = np.flatnonzero(np.diff(alike(x, y).astype(np.int8), prepend=0, append=0)).tolist()
        wanted |= {(k, a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)}
    assert len(wanted) > 200
    assert set(zip(*(v.tolist() for v in near_runs(list(own), list(theirs))), strict=True)) == wanted


def test_pairs_are_not_compared_one_by_one(monkeypatch):
    """Only a pair with a shingle that repeats is compared by itself."""
    calls = []
    monkeypatch.setattr(compact_windows, "alike", lambda *sides: calls.append(sides) or alike(*sides))
    rows = [(x, y) for x, y in pairs(300, repeats=False)]
    columns = {
        "node": range(300), "place": [200] * 300, "back": [40] * 300, "around": [x.tobytes() for x, _ in rows],
        "partner": range(1000, 1300), "partner_place": [100] * 300, "partner_back": [40] * 300,
        "partner_around": [y.tobytes() for _, y in rows],
    }
    found = list(compact_windows._compare_around(iter([pa.RecordBatch.from_pydict({k: list(v) for k, v in columns.items()})])))
    told = {tuple(r.values()) for b in found for r in b.to_pylist()}
    wanted = set()
    for k, (x, y) in enumerate(rows):
        edges = np.flatnonzero(np.diff(alike(x, y).astype(np.int8), prepend=0, append=0)).tolist()
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            wanted |= {(k, 1000 + k, 160 + a, 159 + b + PASSAGE), (1000 + k, k, 60 + a, 59 + b + PASSAGE)}
    assert len(wanted) > 100 and told == wanted and not calls
