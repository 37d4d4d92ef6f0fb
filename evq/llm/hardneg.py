"""Hard-negative mining by exact inner-product search over anchor-clustered shared lists.

For every anchor its positives are the best-scoring other rows of its label; for each positive the hard
negatives are the best rows of another label whose score lies within a band of the positive's score.

Shared lists. Anchors are clustered by direction. For a cluster with centroid c and largest member angle t,
a candidate x at angle a from c scores at most |u| |x| cos(max(0, a - t)) with any member u. Each task sorts
its candidates once per cluster by |x| cos(max(0, a - t)). Every member walks this one list in growing
chunks, scored by a matrix product, and stops when the bound at its place falls below what it still needs:
the k-th best score it holds or the lower edge of its band. Nothing after that place can count, so the
result is exact; bounds are widened beyond rounding. Scores are integers: products run in floating point
while they are exactly representable, in 64-bit integers beyond.

Size. Candidates stay where they are: a pass reads all rows in blocks of `ITEMS`. Anchors are a stated query
set; they are broadcast in blocks of `BLOCK_BYTES`, one block after another, each cut into cluster slices of
about `MEMBERS`. A task returns at most k rows for each anchor and positive, which are ranked by an ordinary
shuffle. Centroids are fitted on at most `SAMPLE` anchors; they steer speed only.

Rows with a null id, label or vector, or a null or non-finite component take no part. Vectors shorter than the
longest are padded by zeros. Equal scores go by the smaller id; repeated rows are rows of their own. Scores that do
not fit 64 bits raise an error. Tables without rows or anchors give an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.llm.common import sliced, staged

CLUSTERS, SAMPLE, MEMBERS = 32, 4096, 1024
BLOCK_BYTES = 32 << 20
ITEMS = 1 << 15
#: First and largest chunk of a walk.
CHUNK, MOST = 256, 4096
NONE = np.iinfo(np.int64).min
EXACT = 1 << 53


@dataclass
class Slice:
    """Members of one cluster: rows, label numbers, vectors, score limits (members x slots), centroid and largest angle."""
    rows: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    centroid: np.ndarray
    angle: float


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _angles(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Angle of each vector to the centroid; a zero vector has angle zero."""
    n = np.linalg.norm(v, axis=1)
    return np.where(n > 0, np.arccos(np.clip(_unit(v) @ c, -1, 1)), 0.0)


def centroids(sample: np.ndarray, clusters: int = CLUSTERS, rounds: int = 10) -> np.ndarray:
    """Unit centroids by spherical k-means, started from evenly spaced rows of the sample."""
    u = _unit(sample.astype(np.float64))
    k = max(1, min(clusters, len(u) // 8))
    c = u[np.linspace(0, len(u) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.argmax(u @ c.T, axis=1)
        c = np.array([m if np.linalg.norm(m := u[near == i].sum(axis=0)) > 0 else c[i] for i in range(k)])
        c = _unit(c)
    return c


def make_slice(rows, labels, vectors, low, high) -> Slice:
    v = vectors.astype(np.float64)
    c = _unit(_unit(v).sum(axis=0))
    return Slice(rows, labels, vectors, low, high, c, float(_angles(v, c).max(initial=0.0)) + 1e-6)


def shared_list(s: Slice, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the items by falling bound, and the bounds in that order (to be multiplied by a member's length)."""
    x = items.astype(np.float64)
    bound = np.linalg.norm(x, axis=1) * np.cos(np.maximum(0.0, _angles(x, s.centroid) - s.angle))
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


class Best:
    """The k best candidates (score, id, row) of every member and slot found so far."""

    def __init__(self, members: int, slots: int, k: int) -> None:
        self.k = k
        self.score = np.full((members, slots, k), NONE, dtype=np.int64)
        self.id, self.row = np.zeros_like(self.score), np.zeros_like(self.score)

    def add(self, slot: int, member: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        u = np.unique(member)
        held = self.score[u, slot] > NONE
        m = np.concatenate((np.repeat(u, held.sum(axis=1)), member))
        s, i, r = (np.concatenate((old[u, slot][held], new)) for old, new in ((self.score, score), (self.id, ids), (self.row, rows)))
        o = np.lexsort((r, i, -s, m))
        m = m[o]
        first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        rank = np.arange(len(m)) - np.repeat(first, np.diff(np.concatenate((first, [len(m)]))))
        o, m, rank = o[rank < self.k], m[rank < self.k], rank[rank < self.k]
        self.score[m, slot, rank], self.id[m, slot, rank], self.row[m, slot, rank] = s[o], i[o], r[o]


def walk(s: Slice, members: np.ndarray, place: np.ndarray, bound: np.ndarray, items: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, same: bool, best: Best) -> int:
    """Let the members walk the list of candidates `place` (falling bounds); returns how many scores were computed.

    same: candidates have the members' label and only the own row is left out; else those of the own label are.
    """
    length = np.linalg.norm(s.vectors.astype(np.float64), axis=1)
    never = s.low > s.high
    seen, at, step, active = 0, 0, CHUNK, members
    while at < len(place) and len(active):
        need = np.where(never[active], np.iinfo(np.int64).max, np.maximum(s.low[active], best.score[active, :, -1])).min(axis=1)
        most = bound[at] * length[active]
        active = active[most + 1e-9 * np.abs(most) + 1e-6 >= need]
        if not len(active):
            break
        c = place[at:at + step]
        score = s.vectors[active] @ items[c].T
        seen += score.size
        if same:
            allowed = np.ones(score.shape, dtype=bool)
            o = np.argsort(s.rows[active])
            i = np.minimum(np.searchsorted(s.rows[active][o], rows[c]), len(o) - 1)
            own = s.rows[active][o][i] == rows[c]
            allowed[o[i[own]], np.flatnonzero(own)] = False
        else:
            allowed = labels[c][None, :] != s.labels[active][:, None]
        for j in range(s.low.shape[1]):
            floor = np.maximum(s.low[active, j], best.score[active, j, -1])[:, None].astype(score.dtype)
            ok = allowed & (score >= floor) & (score <= s.high[active, j][:, None].astype(score.dtype)) & ~never[active, j][:, None]
            if ok.shape[1] > best.k:
                kth = np.partition(np.where(ok, score, NONE), -best.k, axis=1)[:, -best.k]
                ok &= score >= kth[:, None]
            m, x = np.nonzero(ok)
            if len(m):
                best.add(j, active[m], score[m, x].astype(np.int64), ids[c[x]], rows[c[x]])
        at, step = at + step, min(2 * step, MOST)
    return seen


def search(s: Slice, items: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, same: bool, best: Best) -> int:
    """One block of candidates against one slice; returns the number of scores computed."""
    order, bound = shared_list(s, items)
    if not same:
        return walk(s, np.arange(len(s.rows)), order, bound, items, ids, rows, labels, same, best)
    seen = 0
    for label in np.unique(s.labels):
        mine = labels[order] == label
        seen += walk(s, np.flatnonzero(s.labels == label), order[mine], bound[mine], items, ids, rows, labels, same, best)
    return seen


def _matrix(column: pa.ListArray, width: int, kind) -> np.ndarray:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.asarray(pc.list_value_length(column), dtype=np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(kind)
    out = np.zeros((len(sizes), width), dtype=kind)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _scan(items: DataFrame, block: list[Slice], names: list[str], width: int, exact: bool, same: bool, k: int) -> DataFrame:
    """(anchor, slot, score, id, row): the best of each task for every anchor row and slot of the block."""
    held = items.sparkSession.sparkContext.broadcast((block, names))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, known = held.value
        best = [Best(len(s.rows), s.low.shape[1], k) for s in slices]

        def settle(table: pa.Table) -> None:
            t = table.combine_chunks()
            x = _matrix(t.column("q").chunk(0), width, np.float64 if exact else np.int64)
            labels = pc.fill_null(pc.index_in(t.column("label"), value_set=pa.array(known, type=pa.string())), -1).to_numpy()
            for s, b in zip(slices, best, strict=True):
                search(s, x, t.column("id").to_numpy(), t.column("row").to_numpy(), labels, same, b)

        waiting, n = [], 0
        for b in sliced(parts, ITEMS, 1 << 40):
            if b.num_rows:
                waiting.append(b)
                n += b.num_rows
            if n >= ITEMS:
                settle(pa.Table.from_batches(waiting))
                waiting, n = [], 0
        if waiting:
            settle(pa.Table.from_batches(waiting))
        for s, b in zip(slices, best, strict=True):
            m, j, r = np.nonzero(b.score > NONE)
            yield pa.RecordBatch.from_arrays([pa.array(s.rows[m]), pa.array(j.astype(np.int32)), pa.array(b.score[m, j, r]), pa.array(b.id[m, j, r]), pa.array(b.row[m, j, r])],
                                             names=["anchor", "slot", "score", "id", "row"])

    return items.select("row", "id", "label", "q").mapInArrow(run, "anchor long, slot int, score long, id long, row long")


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vectors(table: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(row, id, label, q) of the rows that take part; q: floor(256 x) of every component."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.when(sound, v).alias("v"))
    return rows.filter("id is not null and label is not null and v is not null").select("row", "id", "label", F.transform("v", lambda x: F.floor(256 * x.cast("double"))).alias("q"))


def _sliced_clusters(anchors: DataFrame, members: int, most: int) -> tuple[DataFrame, list[list[tuple[int, int]]]]:
    """Anchors with the column `slice`, and blocks of (cluster, slice) of about `most` anchors each, from one count for each cluster."""
    counts = sorted((r.cluster, r["count"]) for r in anchors.groupBy("cluster").count().collect())
    parts = {c: -(-n // members) for c, n in counts}
    blocks, filled = [[]], 0.0
    for c, n in counts:
        for i in range(parts[c]):
            if filled and filled + n / parts[c] > most:
                blocks, filled = [*blocks, []], 0.0
            blocks[-1].append((c, i))
            filled += n / parts[c]
    number = F.element_at(F.create_map(*[F.lit(x) for item in parts.items() for x in item]), F.col("cluster"))
    return anchors.withColumn("slice", F.pmod(F.xxhash64("row"), number).cast("int")), blocks


def mine(table: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 3,
         band: tuple[int, int] = (50, 95), clusters: int = CLUSTERS, members: int = MEMBERS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: condition on the column `id`; band: least and largest negative score in per cent of the positive's.
    """
    spark = table.sparkSession
    items = staged(vectors(table, id_col, vector_col, F.col("label") if label is None else label), "mining-vectors")
    size = items.agg(F.max(F.size("q")).alias("d"), F.max(F.array_max(F.transform("q", F.abs))).alias("m")).first()
    d, largest = max(size.d or 0, 1), size.m or 0
    if d * largest * largest >= 1 << 63 or largest * 256 >= 1 << 63:
        raise ValueError("scores do not fit 64 bits")
    exact = d * largest * largest < EXACT
    queries = items.filter(anchor)
    fit = queries.orderBy(F.xxhash64("row")).limit(SAMPLE).select("q").toArrow()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not fit.num_rows:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(centroids(_matrix(fit.column("q").combine_chunks(), d, np.float64), clusters))

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(parts, ITEMS, 1 << 40):
            near = np.argmax(_matrix(b.column("q"), d, np.float64) @ held.value.T, axis=1) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=[*b.schema.names, "cluster"])

    queries = staged(queries.mapInArrow(assign, "row long, id long, label string, q array<long>, cluster int"), "mining-anchors")
    queries, blocks = _sliced_clusters(queries, members, max(members, block_bytes // (8 * d)))
    found = []
    for block in blocks:
        wanted = queries.filter(F.concat_ws(":", "cluster", "slice").isin([f"{c}:{i}" for c, i in block]))
        t = wanted.orderBy("cluster", "slice", "row").toArrow()
        rows, label_of = t.column("row").to_numpy(), t.column("label").to_pylist()
        names = sorted(set(label_of))
        number = np.searchsorted(np.array(names), np.array(label_of)).astype(np.int64)
        q = _matrix(t.column("q").combine_chunks(), d, np.float64 if exact else np.int64)
        unit = t.column("cluster").to_numpy().astype(np.int64) << 32 | t.column("slice").to_numpy()

        def slices(low: np.ndarray, high: np.ndarray) -> list[Slice]:
            return [make_slice(rows[m], number[m], q[m], low[m], high[m]) for u in np.unique(unit) for m in [unit == u]]  # noqa: B023

        free = np.full((len(rows), 1), NONE)
        best = staged(_ranked(_scan(items, slices(free, np.full_like(free, np.iinfo(np.int64).max)), names, d, exact, True, positives), ["anchor"], positives), "mining-positives")
        p = best.select("anchor", "rank", "score").toArrow()
        low, high = np.ones((len(rows), positives), dtype=np.int64), np.zeros((len(rows), positives), dtype=np.int64)
        order = np.argsort(rows)
        at, slot = order[np.searchsorted(rows[order], p.column("anchor").to_numpy())], p.column("rank").to_numpy() - 1
        # Least and largest whole score of the band; Python's integers do not overflow.
        limits = [(-(-band[0] * x // 100), band[1] * x // 100) for x in p.column("score").to_pylist()]
        low[at, slot], high[at, slot] = np.array(limits, dtype=np.int64).reshape(-1, 2).T
        worst = staged(_ranked(_scan(items, slices(low, high), names, d, exact, False, negatives), ["anchor", "slot"], negatives), "mining-negatives")
        pairs = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        pairs = pairs.join(wanted.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        found.append(pairs.join(worst.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "slot"])
                     .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out
