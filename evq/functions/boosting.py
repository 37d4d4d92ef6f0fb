"""Histogram gradient boosting of training sets that a task holds, run inside grouped tasks.

Trees are complete binary heaps in arrays: node k has the children 2k + 1 and 2k + 2, feature -1 marks a leaf.
Each level of a tree sums gradients per (node, feature, bin) in one pass and reads all splits off running sums.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Arrays over (tree, node); a score is base + the sum of the leaf values."""
    base: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row, depth = np.arange(len(x)), (self.feature.shape[1] + 1).bit_length() - 2
        for f, t, v in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                g = f[node]
                node = np.where(g >= 0, 2 * node + 1 + (x[row, np.maximum(g, 0)] > t[node]), node)
            out += v[node]
        return out

    def pack(self) -> bytes:
        return pickle.dumps((self.base, self.feature, self.limit, self.value))

    @staticmethod
    def unpack(data: bytes) -> Trees:
        return Trees(*pickle.loads(data))


def bin_edges(x: np.ndarray, bins: int, counts: np.ndarray | None = None) -> list[np.ndarray]:
    """Inner edges per feature: midpoints of distinct values, or of quantiles of the rows where there are more than `bins`.

    counts: how many rows each row of x stands for.
    """
    out = []
    for c in x.T:
        u = np.unique(c)
        if len(u) > bins:
            if counts is None:
                u = np.unique(np.quantile(c, np.linspace(0, 1, bins), method="nearest"))
            else:
                order = np.argsort(c, kind="stable")
                ends = np.cumsum(counts[order])
                at = np.rint(np.linspace(0, 1, bins) * (ends[-1] - 1))
                u = np.unique(c[order[np.searchsorted(ends, at, side="right")]])
        out.append((u[1:] + u[:-1]) / 2)
    return out


def boost(x: np.ndarray, y: np.ndarray, *args, **options) -> Trees:
    """One fit of `boost_all`."""
    return boost_all([(x, y)], *args, **options)[0]


def boost_all(sets: Sequence[tuple[np.ndarray, ...]], logistic: bool, rounds: int, depth: int, rate: float, rows: float, cols: float, ridge: float, least: int,
              bins: int = 32, seed: int = 42) -> list[Trees]:
    """Newton boosting of squared or logistic loss on several training sets, whose trees grow in the same passes.

    A set is (x, y), or (x, y, counts) where each row stands for so many equal ones. rows and cols are the shares drawn for
    each tree; of equal rows their number times the share is drawn, rounded up or down at random in proportion, so that
    every row has the same chance. A set's trees do not depend on the other sets.
    """
    k, m = len(sets), sets[0][0].shape[1]
    size = 2 ** (depth + 1) - 1
    sizes = [len(s[1]) for s in sets]
    x, y, fit = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), np.repeat(np.arange(k), sizes)
    counts = np.concatenate([s[2] if len(s) > 2 else np.ones(n) for s, n in zip(sets, sizes, strict=True)]).astype(float)
    sure = np.floor(counts * rows) if rows < 1 else counts
    edges, code = np.full((k, m, bins), np.inf), np.empty((m, len(y)), dtype=np.int64)
    for i, (s, end) in enumerate(zip(sets, np.cumsum(sizes), strict=True)):
        for j, e in enumerate(bin_edges(s[0], bins, *s[2:])):
            edges[i, j, : len(e)] = e
            code[j, end - sizes[i]:end] = np.searchsorted(e, s[0][:, j], side="left")
    p = np.array([t.mean() if not c else (c[0] * t).sum() / c[0].sum() for _, t, *c in sets])
    base = np.log((q := np.clip(p, 1e-6, 1 - 1e-6)) / (1 - q)) if logistic else p
    f = base[fit]
    draws, pick = [np.random.default_rng(seed) for _ in sets], np.random.default_rng(seed + 1)
    feature, limit, value = np.full((k, rounds, size), -1), np.zeros((k, rounds, size)), np.zeros((k, rounds, size))
    for t in range(rounds):
        q = 1 / (1 + np.exp(-f)) if logistic else f
        drawn = sure + (np.concatenate([r.random(n) for r, n in zip(draws, sizes, strict=True)]) < counts * rows - sure) if rows < 1 else counts
        sums = [(q - y) * drawn, q * (1 - q) * drawn if logistic else drawn, drawn]
        shown = np.sort(pick.permutation(m)[: max(1, round(cols * m))])
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            on = np.flatnonzero(node >= first)
            if not len(on):
                break
            here = slice(None) if len(on) == len(y) else on
            slot = fit[here] * width + node[here] - first
            start, parts = slot * bins, [w[here] for w in sums]
            left = [np.empty((k * width, len(shown), bins)) for _ in sums]
            for i, j in enumerate(shown):
                key = start + code[j][here]
                for to, w in zip(left, parts, strict=True):
                    np.cumsum(np.bincount(key, w, k * width * bins).reshape(k * width, bins), axis=1, out=to[:, i])
            whole = [c[:, :, -1:] for c in left]
            right = [b - a for a, b in zip(left, whole, strict=True)]
            gain = sum(c[0] ** 2 / (np.maximum(c[1], 0) + ridge + 1e-12) for c in (left, right)) - whole[0] ** 2 / (whole[1] + ridge + 1e-12)
            gain[(left[2] < least) | (right[2] < least)] = 0
            best = gain.reshape(k * width, -1).argmax(axis=1)
            split = gain.reshape(k * width, -1)[np.arange(k * width), best] > 1e-12
            j, b = shown[best // bins], best % bins
            s = np.flatnonzero(split)
            feature[s // width, t, first + s % width] = j[s]
            limit[s // width, t, first + s % width] = edges[s // width, j[s], b[s]]
            on, slot = on[split[slot]], slot[split[slot]]
            node[on] = 2 * node[on] + 1 + (x[on, j[slot]] > edges[slot // width, j[slot], b[slot]])
        at = fit * size + node
        gs, hs = (np.bincount(at, w, k * size) for w in sums[:2])
        v = np.where(hs > 0, -rate * gs / (hs + ridge + 1e-12), 0.0)
        value[:, t] = v.reshape(k, size)
        f = f + v[at]
    return [Trees(float(base[i]), feature[i], limit[i], value[i]) for i in range(k)]
