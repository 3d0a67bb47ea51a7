"""The cells and blocks of the n-gram Jaccard join."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from ledgerline.llm.jaccard_join import GROUPS, Rule, _cells_of, best_pairs, blocks_of, join, open_pairs


@pytest.mark.parametrize("rule", [Rule(4, 85), Rule(5, 80)])
def test_linked_sets_share_a_cell(rule):
    pick = np.random.default_rng(rule.size)
    hashes = lambda n: pick.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
    linked = 0
    for _ in range(60):
        sets = []
        for _ in range(12):
            base = hashes(int(pick.choice([1, 2, 4, 5, 6, 7, 8, 10, 12, 20, 40, 90, 200])))
            if pick.random() < 0.3:  # few groups hold all
                base = base >> np.uint64(pick.integers(1, 40))
            for _ in range(4):
                kept = pick.permutation(base)[int(pick.integers(0, len(base) // 4 + 1)) :]
                sets.append(np.unique(np.concatenate([kept, hashes(int(pick.integers(0, len(base) // 5 + 1)))])))
        counts = np.array([len(s) for s in sets])
        cells = defaultdict(set)
        for text, cell in _cells_of(rule, np.repeat(np.arange(len(sets)), counts), np.concatenate(sets), counts):
            for t, c in zip(text.tolist(), cell.tolist(), strict=True):
                cells[t].add(c)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                both = len(np.intersect1d(x, y))
                if not np.array_equal(x, y) and 100 * both >= rule.percent * (len(x) + len(y) - both):
                    linked += 1
                    assert cells[i] & cells[j]
    assert linked > 100


def test_one_cell_of_many_blocks(spark):
    """A cell cut into a dozen blocks gives the pairs that trying all entries gives."""
    rule, pick = Rule(4, 85), np.random.default_rng(4)
    centres = pick.poisson(0.6, (300, GROUPS))
    vectors = np.concatenate([np.maximum(centres + pick.integers(0, 12, (300, 1)) * (pick.random((300, GROUPS)) < 0.02), 0) for _ in range(10)])
    sizes, labels = vectors.sum(1), pick.integers(0, 50, len(vectors))
    wanted = set()
    for i in range(len(vectors)):
        bound = np.minimum(vectors[i], vectors[i + 1 :]).sum(1)
        n = sizes[i + 1 :]
        fits = (100 * n >= 85 * sizes[i]) & (100 * sizes[i] >= 85 * n) & (bound >= rule.overlap(n + sizes[i]))
        wanted |= {(i, i + 1 + int(j)) for j in np.flatnonzero(fits & (labels[i + 1 :] != labels[i]))}
    rows = [(7, i, int(labels[i]), int(sizes[i]), bytearray(v.astype("<i4").tobytes())) for i, v in enumerate(vectors)]
    entries = spark.createDataFrame(rows, "cell bigint, node bigint, label bigint, n bigint, vector binary")
    blocks = blocks_of(entries, most=256)
    got = {(r.a, r.b) for r in open_pairs(blocks, rule).collect()}
    assert len(wanted) > 1000 and got == wanted
    best = {(r.a, r.b) for r in best_pairs(blocks, rule).collect()}
    assert best <= wanted and 0 < len(best) <= len(vectors)


def test_hubs_and_repeated_rows(spark, monkeypatch):
    """With every cell of some copies a hub, the classes are those of the plain way."""
    pick = np.random.default_rng(5)
    word = lambda: f"w{pick.integers(0, 5000)}"
    texts = []
    for _ in range(30):
        base = [word() for _ in range(150)]
        for _ in range(10):
            own = list(base)
            own[int(pick.integers(0, 150))] = word()
            texts.append(" ".join(own))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id int, text string")
    plain = sorted(map(tuple, join(frame).collect()))
    monkeypatch.setattr("ledgerline.llm.jaccard_join.BUCKET", 10)
    monkeypatch.setattr("ledgerline.llm.jaccard_join.HUBS", 300)
    assert sorted(map(tuple, join(frame).collect())) == plain
    assert len({c for _, _, c in plain}) < 100
