"""The predictors, gates and online mixing of op6, as numpy work inside tasks.

A window is the longest context and the byte after it, as one integer; the byte
itself is lowest. Windows that share the two bytes before the last belong together:
the counts of every context of two bytes or more are whole where all of them meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

#: Context bytes of the predictors. Only the first is shorter than what names a block.
ORDERS = (1, 2, 3, 4, 5)
WIDTH = max(ORDERS) + 1
#: Inputs of a mixer: two for each order, and a constant.
INPUTS = 2 * len(ORDERS) + 1
#: Gates of the first mixer: longest order known and bit position; of the second:
#: how often the longest known context was seen, and bit position.
LEVELS = 8
GATES = (8 * (len(ORDERS) + 1), 8 * LEVELS)
#: Points of the adaptive map, from -REACH to REACH in the logistic domain.
BUCKETS, REACH = 33, 12.0
#: Margins of a bit: of the first mixer, of the adaptive map after it, of the second mixer.
LAYERS = 3
#: Whole steps of a margin in each direction, so that the eight bits of a layer are one long.
MARGIN_STEPS = 127
#: Bytes of a text after which its own weights are updated, and the step of an update.
STEP, RATE = 32, 0.005
#: Texts that are mixed side by side.
LANES = 256
#: How sure a count makes, up to where it makes no difference any more.
_SURE = np.minimum(np.log1p(np.arange(2**12, dtype=np.float32)), 8) / 4


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The window of each byte and of each end, as integers; and the windows of each text.

    Before a text there are zeros, and its end is a zero.
    """
    lead = b"\0" * (WIDTH - 1)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(lead + t + b"\0" for t in texts), np.uint8)
    packed = data.astype(np.uint64)
    for k in range(1, WIDTH):
        packed[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k)
    inside = np.ones(len(data), bool)
    starts = np.cumsum(sizes + WIDTH - 1) - (sizes + WIDTH - 1)
    for k in range(WIDTH - 1):
        inside[starts + k] = False
    return packed[inside], sizes


def bits_of(grams: np.ndarray) -> np.ndarray:
    """The bits of the last byte, highest first: [windows, 8]."""
    symbol = (grams & np.uint64(0xFF)).astype(np.int64)
    return (symbol[:, None] >> np.arange(7, -1, -1)) & 1


def near_counts(pairs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Counts of zeros and ones after one byte of context: [2, contexts, bits so far].

    ``pairs`` are a context byte and the byte after it, 65,536 at most.
    """
    out = np.zeros((2, 256, 256))
    context, symbol = pairs >> 8, pairs & 255
    for bit in range(8):
        np.add.at(out, ((symbol >> (7 - bit)) & 1, context, (symbol | 256) >> (8 - bit)), n)
    return out


def counts_of(grams: np.ndarray, n: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones seen after each context and the bits so far: [windows, orders, 8].

    ``grams`` are all windows of a block, each once, with their counts. In the order of
    context and byte, windows that share a context and the bits so far stand together.
    """
    seen = np.empty((2, len(grams), len(ORDERS), 8), np.float32)
    if not len(grams):
        return seen[0], seen[1]
    symbol = grams & np.uint64(0xFF)
    for o, order in enumerate(ORDERS):
        if order == 1:
            context = (grams >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64)
            for bit in range(8):
                node = (symbol | np.uint64(0x100)) >> np.uint64(8 - bit)
                seen[:, :, o, bit] = near[:, context, node.astype(np.int64)]
            continue
        key = grams & np.uint64((1 << (8 * (order + 1))) - 1)
        place = np.argsort(key)
        new = np.diff(key[place], prepend=~key[place[0]]) != 0
        key, each = key[place[new]], np.add.reduceat(n[place].astype(float), np.flatnonzero(new))
        held = np.empty((2, 8, len(key)), np.float32)
        for bit in range(8):
            node = key >> np.uint64(8 - bit)
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            size = np.diff(np.append(first, len(node)))
            one = np.add.reduceat(each * (key >> np.uint64(7 - bit) & np.uint64(1)), first)
            held[1, bit] = np.repeat(one, size)
            held[0, bit] = np.repeat(np.add.reduceat(each, first) - one, size)
        index = np.empty(len(grams), np.int64)
        index[place] = np.cumsum(new) - 1
        for value in (0, 1):
            seen[value, :, o] = np.ascontiguousarray(held[value].T).take(index, axis=0)
    return seen[0], seen[1]


def without_itself(grams: np.ndarray, n: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
    """The counts without one sight of the window itself, where it was seen."""
    own = np.minimum(n, 1)[:, None, None].astype(np.float32)
    one = (bits_of(grams)[:, None, :] == 1) * own
    return np.maximum(zeros - (own - one), 0), np.maximum(ones - one, 0)


def inputs(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Mixer inputs [windows, 8, INPUTS] and the gates of both mixers [windows, 8]."""
    total = zeros + ones
    stretch = np.log((ones + 0.02) / (zeros + 0.02))
    sure = _SURE.take(np.minimum(total, len(_SURE) - 1).astype(np.int64))
    x = np.ones((len(total), INPUTS, 8), np.float32)
    x[:, : len(ORDERS)] = stretch
    np.multiply(stretch, sure, out=x[:, len(ORDERS) : -1])
    known = (total > 0).sum(1)  # a longer order implies the shorter ones
    last = np.take_along_axis(total, np.maximum(known - 1, 0)[:, None, :], 1)[:, 0]
    level = np.minimum(np.log2(1 + last), LEVELS - 1).astype(np.int64)
    return x.transpose(0, 2, 1), [known * 8 + np.arange(8), level * 8 + np.arange(8)]


def start() -> list[np.ndarray]:
    """The weights of both mixers before anything is learned: the mean of the orders."""
    weights = [np.zeros((gates, INPUTS), np.float32) for gates in GATES]
    for w in weights:
        w[:, : len(ORDERS)] = 1 / len(ORDERS)
    return weights


def learned(
    weights: np.ndarray, x: np.ndarray, gate: np.ndarray, bits: np.ndarray, each: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The weights of a mixer after an online pass over windows, and what each gate saw."""
    weights, seen = weights.copy(), np.zeros(len(weights))
    squares = np.full_like(weights, 1e-2)
    for a in range(0, len(x), 256):
        part = slice(a, a + 256)
        g, rows, much = gate[part].ravel(), x[part].reshape(-1, INPUTS), np.repeat(each[part], 8)
        s = np.clip((rows * weights[g]).sum(1), -REACH, REACH)
        error = (bits[part].ravel() - 1 / (1 + np.exp(-s))) * much
        at_gate = (np.arange(len(weights))[:, None] == g).astype(np.float32)
        slope = at_gate @ (rows * error[:, None].astype(np.float32))
        hits = np.bincount(g, much, len(weights))
        slope /= np.maximum(hits, 1e-9)[:, None].astype(np.float32)
        squares += slope**2
        weights += 0.05 * slope / np.sqrt(squares)
        seen += hits
    return weights, seen


def sums(weights: np.ndarray, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """What a mixer gives for each bit, in the logistic domain."""
    return np.clip(np.einsum("...i,...i->...", x, weights[gate]), -REACH, REACH)


def map_start() -> np.ndarray:
    """The adaptive map before anything is learned: a gate's points as they are."""
    points = 1 / (1 + np.exp(-np.linspace(-REACH, REACH, BUCKETS)))
    return np.tile(points, (GATES[0], 1))


def nearest(s: np.ndarray) -> np.ndarray:
    """The nearest point of the adaptive map."""
    return np.rint((s + REACH) * ((BUCKETS - 1) / (2 * REACH))).astype(np.int64)


@dataclass
class Model:
    """What all windows share: the weights of both mixers, and the adaptive map."""

    weights: list[np.ndarray]
    refined: np.ndarray

    def margins(self, grams: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """For each layer and bit the log odds of what the bit is: [windows, LAYERS, 8]."""
        x, gates = inputs(zeros, ones)
        first, second = (sums(w, x, g) for w, g in zip(self.weights, gates, strict=True))
        at = (first + REACH) * ((BUCKETS - 1) / (2 * REACH))
        low = np.minimum(at.astype(np.int64), BUCKETS - 2)
        p = self.refined[gates[0], low] * (1 - (at - low)) + self.refined[gates[0], low + 1] * (at - low)
        p = np.clip(p, 1e-5, 1 - 1e-5)
        layers = np.stack([first, np.log(p / (1 - p)), second], axis=1)
        return np.where(bits_of(grams)[:, None, :] == 1, layers, -layers)


def rounded(margins: np.ndarray) -> np.ndarray:
    """Margins in whole steps of REACH / MARGIN_STEPS."""
    return np.rint(np.clip(margins / REACH, -1, 1) * MARGIN_STEPS).astype(np.int8)


def mixed_online(margins: np.ndarray, codes: np.ndarray, sizes: np.ndarray, rate: float = RATE) -> np.ndarray:
    """log10 of the probability of each text, whose weights of the layers move along it.

    ``margins`` are [windows, LAYERS, 8] as ``rounded`` gives them, ``codes`` the window of each byte of the texts
    one after the other. Each text starts with equal weights, one set a bit position, and
    after STEP bytes they take a step down the slope of what those bytes cost. So a byte
    is predicted from the bytes before it only.
    """
    none = len(margins)
    # the eight bits of a layer as one long, with one more window of no margins
    layers = [np.append(np.ascontiguousarray(margins[:, i]).view(np.int64).ravel(), 0) for i in range(LAYERS)]
    unit = np.float32(REACH / MARGIN_STEPS)
    starts, out = np.cumsum(sizes) - sizes, np.empty(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    for a in range(0, len(order), LANES):
        lanes = order[a : a + LANES]
        size = sizes[lanes]
        steps = -(-size // STEP)
        # the texts that still go on are always the first ones
        active = np.searchsorted(-steps, -np.arange(steps[0]), side="left")
        offset = np.cumsum(active) - active
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row = offset[place // STEP] + np.repeat(np.arange(len(lanes)), size)
        padded = np.full(active.sum() * STEP, none, np.int64)
        padded[row * STEP + place % STEP] = codes[np.repeat(starts[lanes], size) + place]
        padded = padded.reshape(-1, STEP)
        weights = np.full((LAYERS, 8, len(lanes)), 1 / LAYERS, np.float32)
        cost = np.zeros(len(lanes))
        for first, m in zip(offset, active, strict=True):
            # bits first, then bytes, so that what is done to all texts at once lies together
            at = padded[first : first + m].T
            z = [np.multiply(layer.take(at).view(np.int8).reshape(STEP, m, 8).transpose(2, 0, 1), unit, order="C") for layer in layers]
            s = z[0] * weights[0, :, None, :m]
            for i in range(1, LAYERS):
                s += z[i] * weights[i, :, None, :m]
            np.clip(s, -REACH, REACH, out=s)
            odds = np.exp(np.negative(s, out=s), out=s)
            whole = 1 + odds
            # the logarithm of a product of four, which stays within 32 bits
            four = whole[:4] * whole[4:]
            four = four[:2] * four[2:]
            cost[:m] += np.log(four).sum((0, 1), dtype=np.float64)
            missed = np.divide(odds, whole, out=odds)
            for i in range(LAYERS):
                weights[i, :, :m] += rate * np.multiply(missed, z[i], out=z[i]).sum(1)
        out[lanes] = -(cost - (steps * STEP - size) * 8 * np.log(2)) / np.log(10)
    return out
