"""Quality rules: document statistics, hard base rules and gradient-boosted trees.

Statistics are taken over whole texts, one document at a time. The trees are histogram boosted with
logistic loss; chosen features are constrained, so that more symbols, repeats or duplicate lines
never raise a score. A model is flattened into node arrays and scores whole columns at once in numpy.

Training takes a documented sample: the MAX_LABELLED labelled rows with the smallest hash of their
id. Everything else covers all rows. Without labels of both kinds the model keeps everything.

Null and empty texts have no words and fail the base rules. Repeated rows and ids stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.common import sliced, staged

MAX_LABELLED = 20_000
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_capitals", "n_marks", "n_digits", "n_again", "n_distinct")
FEATURES = ("symbols", "capitals", "marks", "digits", "again", "repeat", "dup_lines", "word_length", "distinct", "log_words")
#: -1: the score never rises with the feature, +1: it never falls.
MONOTONE = {"symbols": -1, "marks": -1, "again": -1, "repeat": -1, "dup_lines": -1}
_MULTIPLIERS = np.random.default_rng(8).integers(1, 2**63, size=WINDOW, dtype=np.uint64) | np.uint64(1)
_CLASS = np.zeros(256, dtype=np.uint8)
for _chars, _bit in ((b" \t\n\r\x0b\x0c", 1), (b"#*$%&|<>", 2), (bytes(range(65, 91)), 4), (b"!", 8), (b"0123456789", 16), (bytes(range(128, 192)), 32)):
    _CLASS[list(_chars)] |= _bit


def repeated_words(words: list[bytes], window: int = WINDOW) -> tuple[int, int]:
    """(words inside windows that occur twice or more, distinct words)."""
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - window + 1
    if n < 2:
        return 0, len(ids)
    # Equal windows have equal sums; only windows with an equal sum are compared word by word.
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        sums += (at[k:k + n] + np.uint64(1)) * _MULTIPLIERS[k]
    order = np.argsort(sums, kind="stable")
    same = sums[order[1:]] == sums[order[:-1]]
    if not same.any():
        return 0, len(ids)
    maybe = np.union1d(order[1:][same], order[:-1][same])
    rows = np.stack([at[maybe + k] for k in range(window)], axis=1)
    _, back, times = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    begins = maybe[times[back.reshape(-1)] > 1]
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, begins, 1)
    np.add.at(edges, begins + window, -1)
    return int((np.cumsum(edges) > 0).sum()), len(ids)


def text_statistics(text: str | None) -> tuple[int, ...]:
    """BASE and EXTRA of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    kinds = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=64)
    lines, seen, dups = 0, set(), 0
    for x in raw.split(b"\n"):
        if x.strip():
            lines += 1
            if x in seen:
                dups += 1
            seen.add(x)
    repeat, distinct = repeated_words(words)
    again = sum(map(bytes.__eq__, words[1:], words)) if words else 0
    return (len(words), int(len(raw) - kinds[1] - kinds[32]), int(kinds[2]), dups, repeat, lines, int(kinds[4]), int(kinds[8]), int(kinds[16]), again, distinct)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, BASE, EXTRA) per row."""
    names = (*BASE, *EXTRA)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(parts):
            rows = np.array([text_statistics(t) for t in b.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(rows[:, j]) for j in range(len(names))]], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in names))


def features(v: dict[str, np.ndarray]) -> np.ndarray:
    """Feature matrix in the order of FEATURES from columns BASE and EXTRA."""
    words, chars, lines = np.maximum(v["n_words"], 1), np.maximum(v["word_chars"], 1), np.maximum(v["n_lines"], 1)
    return np.column_stack([v["n_symbols"] / chars, v["n_capitals"] / chars, v["n_marks"] / chars, v["n_digits"] / chars, v["n_again"] / words, v["n_repeat_words"] / words,
                            v["n_dup_lines"] / lines, v["word_chars"] / words, v["n_distinct"] / words, np.log1p(v["n_words"])]).astype(np.float64)


@dataclass
class Forest:
    """Trees in one set of node arrays; a leaf points to itself. `roots`: first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row: all trees of all rows step down together."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.start + self.value[node].sum(axis=1)


def boost(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Forest:
    """Histogram boosting with logistic loss under monotonic constraints.

    A split that orders its two leaf values against a constraint is refused, and the middle of the two
    bounds the values below either side, so the whole tree keeps the order.
    """
    n, m = x.shape
    nodes: list[list[float]] = []
    roots: list[int] = []
    mean = min(max(float(y.mean()) if n else 1.0, 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for j in range(m)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)]) if n else np.zeros((0, m), dtype=int)
    f = np.full(n, start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, left_depth: int) -> int:
        at = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + ridge), low, high))
        nodes.append([0, np.inf, at, at, value * rate])
        best = (1e-6, None)
        if left_depth:
            for j in range(m):
                k = len(cuts[j]) + 1
                gl = np.cumsum(np.bincount(binned[rows, j], g[rows], k))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h[rows], k))[:-1]
                gr, hr = gs - gl, hs - hl
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * wl + 0.5 * (hl + ridge) * wl**2 + gr * wr + 0.5 * (hr + ridge) * wr**2) + (gs * value + 0.5 * (hs + ridge) * value**2)
                ok = (hl >= least) & (hr >= least) & ((wr - wl) * monotone[j] >= 0)
                if ok.any():
                    c = int(np.argmax(np.where(ok, gain, -np.inf)))
                    if gain[c] > best[0]:
                        best = (float(gain[c]), (j, c, float(wl[c]), float(wr[c])))
        if best[1]:
            j, c, wl, wr = best[1]
            goes = binned[rows, j] <= c
            mid = (wl + wr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[j]]
            a = grow(rows[goes], g, h, *bounds[0], left_depth - 1)
            b = grow(rows[~goes], g, h, *bounds[1], left_depth - 1)
            nodes[at] = [j, cuts[j][c], a, b, 0.0]
        return at

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-f))
        roots.append(grow(np.arange(n), p - y, np.maximum(p * (1 - p), 1e-9), -np.inf, np.inf, depth))
        one = _flat(nodes, roots[-1:], depth, 0.0)
        f = f + one.scores(x)
    return _flat(nodes, roots, depth, start)


def _flat(nodes: list[list[float]], roots: list[int], depth: int, start: float) -> Forest:
    a = np.array(nodes, dtype=np.float64).reshape(-1, 5)
    return Forest(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots, dtype=np.int64), depth, start)


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", most: int = MAX_LABELLED) -> Forest:
    """Fit on at most `most` labelled rows: those with the smallest hash of their id."""
    known = labels.filter(F.col(quality_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(quality_col).cast("double")).alias("y"))
    rows = stats.join(known, "id").orderBy(F.xxhash64("id"), "id", *BASE).limit(most).toPandas()
    x = features({c: rows[c].to_numpy() for c in (*BASE, *EXTRA)})
    return boost(x, (rows["y"].to_numpy() > 0).astype(float), [MONOTONE.get(f, 0) for f in FEATURES])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    """(id, BASE, EXTRA, base_failed, p_quality, kept) per row."""
    stats = staged(statistics(docs, id_col, text_col), "statistics")
    forest = docs.sparkSession.sparkContext.broadcast(train(stats, labels, id_col, quality_col, most))
    names = [*BASE, *EXTRA]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(parts):
            v = {c: b.column(c).to_numpy() for c in names}
            p = 1 / (1 + np.exp(-forest.value.scores(features(v))))
            failed = (v["n_words"] < 20) | (100 * v["n_repeat_words"] > 30 * v["n_words"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(p), pa.array(~failed & (p >= 0.5))], names=["id", *names, "base_failed", "p_quality", "kept"])

    kind = stats.schema["id"].dataType.simpleString()
    return stats.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, p_quality double, kept boolean")
