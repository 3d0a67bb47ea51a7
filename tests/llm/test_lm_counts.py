"""The model's score of op6 against counts by brute force and mixing text by text."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import context_mixing as mixing
from ledgerline.llm import lm_scoring
from ledgerline.llm.lm_scoring import LAYERS, learn_model, score

LONG = max(mixing.ORDERS)


def cuts(text):
    padded = b"\0" * LONG + text.encode() + b"\0"
    return [padded[i : i + LONG + 1] for i in range(len(padded) - LONG)]


def places(w):
    """order, context, bits so far, and the next bit, for each order and bit of a window."""
    for order in mixing.ORDERS:
        for bit in range(8):
            yield order, w[LONG - order : LONG], (w[-1] | 256) >> (8 - bit), (w[-1] >> (7 - bit)) & 1


def brute_counts(texts):
    counts = Counter()
    for w, n in Counter(w for t in texts for w in cuts(t)).items():
        for place in places(w):
            counts[place] += n
    return counts


def brute_margins(w, counts, model):
    out = np.zeros((mixing.LAYERS, 8))
    for bit in range(8):
        node, own = (w[-1] | 256) >> (8 - bit), (w[-1] >> (7 - bit)) & 1
        held = [[counts[o, w[LONG - o : LONG], node, v] for v in (0, 1)] for o in mixing.ORDERS]
        stretch = [np.log((b + 0.02) / (a + 0.02)) for a, b in held]
        sure = [min(np.log1p(a + b), 8) / 4 for a, b in held]
        x = np.array(stretch + [u * v for u, v in zip(stretch, sure)] + [1])
        known = sum(a + b > 0 for a, b in held)
        level = int(min(np.log2(1 + sum(held[max(known - 1, 0)])), mixing.LEVELS - 1))
        first, second = (
            np.clip(x @ w[gate * 8 + bit], -mixing.REACH, mixing.REACH)
            for w, gate in zip(model.weights, (known, level))
        )
        points = np.linspace(-mixing.REACH, mixing.REACH, mixing.BUCKETS)
        p = np.clip(np.interp(first, points, model.refined[known * 8 + bit]), 1e-5, 1 - 1e-5)
        out[:, bit] = np.array([first, np.log(p / (1 - p)), second]) * (1 if own else -1)
    step = mixing.REACH / mixing.MARGIN_STEPS
    return np.round(out / step) * step


def brute_online(margins, rate=mixing.RATE):
    """The last mixer byte by byte, its weights moved after every STEP bytes."""
    weights, slope, total = np.full((mixing.LAYERS, 8), 1 / mixing.LAYERS), np.zeros((mixing.LAYERS, 8)), 0.0
    for i, z in enumerate(margins):
        p = 1 / (1 + np.exp(-np.clip((weights * z).sum(0), -mixing.REACH, mixing.REACH)))
        total += np.log10(p).sum()
        slope += (1 - p) * z
        if (i + 1) % mixing.STEP == 0:
            weights, slope = weights + rate * slope, np.zeros_like(slope)
    return total


def made(words, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def told(spark, texts, learn):
    given = spark.createDataFrame(
        [(i, t, i in learn) for i, t in enumerate(texts)], "doc_id long, text string, seen boolean"
    )
    return {r.doc_id: r for r in score(given, F.col("seen")).collect()}


def counted(spark, texts):
    grams, n = np.unique(mixing.windows([t.encode() for t in texts])[0], return_counts=True)
    return spark.createDataFrame([(int(g), int(k)) for g, k in zip(grams, n)], "gram long, n long")


@pytest.mark.parametrize("rate", [0, mixing.RATE, 0.05])
def test_online_mixing_text_by_text(rate):
    """Texts of many lengths side by side are mixed as each would be by itself."""
    rng = np.random.default_rng(1)
    margins = mixing.rounded(rng.normal(1, 3, (500, mixing.LAYERS, 8)))
    sizes = np.array([1, 31, 32, 33, 64, 700, 5, 1, 2000] * 40)
    codes = rng.integers(0, len(margins), sizes.sum())
    got = mixing.mixed_online(margins, codes, sizes, rate)
    ends = np.cumsum(sizes)
    wanted = [brute_online(margins[codes[b - n : b]] * (mixing.REACH / mixing.MARGIN_STEPS), rate) for b, n in zip(ends, sizes)]
    assert got == pytest.approx(np.array(wanted), rel=1e-4)


def test_score_with_large_counts_and_unseen_contexts(spark, monkeypatch):
    """Blocks of a few windows; after an a come 800,000 and 100,000 bytes that differ in a bit."""
    monkeypatch.setattr("ledgerline.llm.lm_scoring.BLOCK_WINDOWS", 5)
    texts = ["aaaaaaaaab" * 10_000] * 10 + ["the cat sat on the mat", "é 你好", None, ""]
    counts = brute_counts([t or "" for t in texts])
    assert min(counts[1, b"a", 0b1011000, v] for v in (0, 1)) > 65_000
    asked = ["aaaaaaaaab" * 20, "ab" * 30, "the dog sat", "", None, "你 cat"]
    learn = range(len(texts))
    rows = told(spark, texts + asked, learn)
    # windows that are only asked for take part with a count of none
    every = counted(spark, [t or "" for t in texts]).union(
        counted(spark, [t or "" for t in asked]).withColumn("n", F.lit(0).cast("long"))
    )
    model, _ = learn_model(spark, every.groupBy("gram").agg(F.sum("n").alias("n")))
    for i, text in enumerate(asked):
        margins = [brute_margins(w, counts, model) for w in cuts(text or "")]
        assert rows[len(texts) + i].score == pytest.approx(brute_online(margins), rel=2e-3)


def test_every_row_and_every_part(spark, monkeypatch):
    """Parts of one text or of many give the same scores, and copies the same."""
    texts = [made(["red", "green", "blue", "x" * 30], n, n) for n in (1, 3, 50, 400)] * 3
    whole = told(spark, texts, range(0, 12, 2))
    monkeypatch.setattr("ledgerline.llm.lm_scoring.PART", 10)
    cut = told(spark, texts, range(0, 12, 2))
    assert len(whole) == len(cut) == 12
    for i in range(12):
        assert whole[i].score == pytest.approx(cut[i].score, rel=1e-3)
        assert whole[i].score == pytest.approx(whole[i % 4].score, rel=1e-6)


def test_learning_helps_on_unseen_texts(spark):
    """Texts like the ones learned from cost less than others, and weights that move less than fixed ones."""
    words = [made("abcdefghij", 6, k).replace(" ", "") for k in range(300)]
    texts = [made(words, 200, k) for k in range(40)] + [made(list("klmnopqrst"), 400, 99)]
    rows = told(spark, texts, range(30))
    unseen = np.mean([rows[i].bits_per_byte for i in range(30, 40)])
    nothing = told(spark, texts, [])
    assert unseen < 0.4 * rows[40].bits_per_byte
    assert unseen < 0.4 * np.mean([nothing[i].bits_per_byte for i in range(30, 40)])
    model, margins = learn_model(spark, counted(spark, texts[:30]))
    there = {r.gram: np.array([r[c] for c in LAYERS]).view(np.int8).reshape(-1, 8) for r in margins.collect()}
    # a text of another kind, made of windows that the model knows
    odd = list(there)[:2000]
    table = np.stack([there[g] for g in odd])
    moved, fixed = (mixing.mixed_online(table, np.arange(2000), np.array([2000]), r)[0] for r in (mixing.RATE, 0))
    assert moved > fixed


def test_margins_are_dealt_small_and_whole():
    """Windows in any order, of two parts, with layers that differ by little, as they do."""
    rng, n = np.random.default_rng(1), 40_000
    grams = np.unique(rng.integers(0, 2**47, n))
    first = np.clip(np.rint(rng.laplace(60, 40, (len(grams), 1, 8))), -127, 127)
    near = np.rint(rng.laplace(0, 2, (len(grams), mixing.LAYERS - 1, 8)))
    margins = np.clip(np.concatenate([first, first + near], axis=1), -127, 127).astype(np.int8)
    part, order = rng.integers(0, 2, len(grams)), rng.permutation(len(grams))
    longs = margins.reshape(len(grams), -1).view(np.int64)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c[order]) for c in (part, grams, *longs.T)], ["part", "gram", *LAYERS]
    )
    rows = [r for b in lm_scoring._dealt(iter([batch])) for r in b.to_pylist()]
    assert sum(len(r["told"]) for r in rows) < 0.75 * 32 * len(grams)
    for k in (0, 1):
        got = [lm_scoring._unpacked(r["told"]) for r in rows if r["part"] == k]
        assert np.array_equal(np.concatenate([g for g, _ in got]), grams[part == k])
        assert np.array_equal(np.concatenate([m for _, m in got]), margins[part == k])


@pytest.mark.parametrize("n", [1, 2])
def test_few_margins_are_packed(n):
    grams, margins = np.array([5, 2**47])[:n], np.full((n, mixing.LAYERS, 8), -127, np.int8)
    got = lm_scoring._unpacked(lm_scoring._packed(grams, margins))
    assert np.array_equal(got[0], grams) and np.array_equal(got[1], margins)


def test_windows_go_by_pair_and_not_row_by_row(spark, monkeypatch):
    """Nothing that is stored on the way has a row for each window, and no margins are stored."""
    kept, keep = {}, lm_scoring.stored
    monkeypatch.setattr(lm_scoring, "stored", lambda frame, name: kept.setdefault(name, keep(frame, name)))
    sizes, release = {}, lm_scoring.release

    def spy(session):
        sizes.update({name: frame.count() for name, frame in kept.items()})
        release(session)

    monkeypatch.setattr(lm_scoring, "release", spy)
    texts = [made("abcdefghij", 3000, k).replace(" ", "") for k in range(4)]
    different = {w for t in texts for w in cuts(t)}
    assert len(told(spark, texts, range(3))) == 4
    assert sizes["lm-parts"] < 0.1 * len(different) and sizes["lm-windows"] < 0.1 * len(different)
    assert "lm-margins" not in kept


@pytest.mark.parametrize("most", [10, 10**6])
def test_windows_of_a_pair_come_back(monkeypatch, most):
    """Windows and counts of any size, a byte of 255 in the text, and rows of few windows."""
    monkeypatch.setattr(lm_scoring, "MOST_PRESSED", most)
    rng = np.random.default_rng(2)
    grams = np.unique(np.append(mixing.windows([bytes([255, 0, 255]) * 30, b"abcab" * 9])[0], rng.integers(0, 2**48, 500).astype(np.uint64)))
    n = rng.integers(0, 2**40, len(grams))
    rows = lm_scoring._pair_rows(grams, n)
    assert all(many <= most for _, many, _ in rows) and sum(many for _, many, _ in rows) == len(grams)
    back = [lm_scoring._unpressed(pair, raw) for pair, _, raw in rows]
    got, counts = (np.concatenate(v) for v in zip(*back))
    order = np.argsort(got)
    assert np.array_equal(got[order], grams) and np.array_equal(counts[order], n)


def test_windows_that_share_a_context_are_packed_small():
    """The odds of a bit are the same after the same context and bits; what differs comes back too."""
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 2**30, 4000).astype(np.uint64) << np.uint64(8) | np.uint64(97))
    grams = np.concatenate([grams, grams + np.uint64(1), grams + np.uint64(2)])
    grams.sort()
    odds, margins = {}, np.empty((len(grams), mixing.LAYERS, 8), np.int8)
    for i, (g, bits) in enumerate(zip(grams.tolist(), mixing.bits_of(grams))):
        for bit in range(8):
            node = (g >> (8 - bit), bit)
            if node not in odds:
                odds[node] = rng.integers(-127, 128, mixing.LAYERS)
            margins[i, :, bit] = odds[node] if bits[bit] else -odds[node]
    margins[7] = rng.integers(-127, 128, (mixing.LAYERS, 8))
    raw = lm_scoring._packed(grams.view(np.int64), margins.view(np.int64)[:, :, 0])
    got = lm_scoring._unpacked(raw)
    assert np.array_equal(got[0], grams.view(np.int64)) and np.array_equal(got[1], margins)
    assert len(raw) < 0.6 * 24 * len(grams)


def test_counts_of_a_block_by_brute_force():
    texts = [made("abé\x00ÿ", 300, k) for k in range(3)]
    grams, n = np.unique(mixing.windows([t.encode() for t in texts])[0], return_counts=True)
    counts = brute_counts(texts)
    pairs = (grams & np.uint64(0xFFFF)).astype(np.int64)
    zeros, ones = mixing.counts_of(grams, n, mixing.near_counts(pairs, n.astype(float)))
    for i in range(0, len(grams), 7):
        w = int(grams[i]).to_bytes(8, "big")[2:]
        wanted = [[counts[(*place[:3], v)] for v in (0, 1)] for place in places(w)]
        assert np.array_equal(np.stack([zeros[i].ravel(), ones[i].ravel()], 1), np.array(wanted, float))
