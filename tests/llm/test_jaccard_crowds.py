"""What a crowded cell costs the n-gram Jaccard join."""

from __future__ import annotations

import numpy as np

from ledgerline.llm import jaccard_join
from ledgerline.llm.jaccard_join import GROUPS, Rule, _best, _open, best_pairs, blocks_of, open_pairs


def near_copies(n: int, pick) -> np.ndarray:
    """Count vectors of ``n`` near copies of one set."""
    vectors = np.tile(pick.poisson(1.5, GROUPS), (n, 1))
    return vectors + (pick.random((n, GROUPS)) < 0.02)


def block(n: int, strange: int) -> dict:
    """One cell of ``n`` near copies of one component, ``strange`` of which have one of their own."""
    vectors = near_copies(n, np.random.default_rng(3)).astype("u1")
    labels = np.where(np.arange(n) < strange, np.arange(n) + 10, 1)
    columns = {"cells": np.zeros(n, np.int64), "nodes": np.arange(n), "labels": labels, "sizes": vectors.sum(1).astype(np.int64)}
    return {k: v.tobytes() for k, v in columns.items()} | {"vectors": vectors.tobytes()}


def compared(monkeypatch, work) -> int:
    """Pairs of vectors that ``work`` compares."""
    pairs, plain = [], jaccard_join.overlaps

    def counted(one, other):
        out = plain(one, other)
        pairs.append(out.size)
        return out

    monkeypatch.setattr(jaccard_join, "overlaps", counted)
    work()
    monkeypatch.setattr(jaccard_join, "overlaps", plain)
    return sum(pairs)


def test_a_crowd_costs_no_square(monkeypatch):
    rule = Rule(4, 85)
    for work, strange in ((_best, 4000), (_open, 5)):
        few, many = (compared(monkeypatch, lambda n=n: work(block(n, strange), rule)) for n in (1000, 4000))
        assert 0 < many < 4.5 * few
    assert _best(block(1000, 1000), rule).num_rows == 1000
    assert _open(block(1000, 5), rule).num_rows == 5 * 995 + 10


def test_small_cells_share_a_block(spark):
    """The pairs of many small cells, a large one and wide counts are those that trying all gives."""
    rule, pick, rows, wanted = Rule(4, 85), np.random.default_rng(8), [], set()
    for cell, held in enumerate([2] * 40 + [7] * 20 + [64, 65, 300]):
        vectors = near_copies(held, pick)
        if cell % 10 == 3:
            vectors[:, 0] += 70_000 if cell % 20 == 3 else 300
        nodes, labels, sizes = pick.permutation(1000)[:held], pick.integers(0, 3, held), vectors.sum(1)
        for i in range(held):
            kind = "u1" if vectors[i].max() < 256 else "<u2" if vectors[i].max() < 65536 else "<i4"
            rows.append((cell, int(nodes[i]), int(labels[i]), int(sizes[i]), bytearray(vectors[i].astype(kind).tobytes())))
            for j in range(i):
                bound = np.minimum(vectors[i], vectors[j]).sum()
                if labels[i] != labels[j] and bound >= rule.overlap(sizes[i] + sizes[j]):
                    if 100 * min(sizes[i], sizes[j]) >= 85 * max(sizes[i], sizes[j]):
                        wanted.add((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
    entries = spark.createDataFrame(rows, "cell bigint, node bigint, label bigint, n bigint, vector binary")
    blocks = blocks_of(entries)
    # the first and the last cell of each of some tasks are alone
    assert blocks.count() <= 3 * 8
    assert len(wanted) > 1000 and {(r.a, r.b) for r in open_pairs(blocks, rule).collect()} == wanted
    assert {(r.a, r.b) for r in best_pairs(blocks, rule).collect()} <= wanted
