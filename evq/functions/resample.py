"""Counter-based resampling: a draw is a pure function of its replicate and its place.

Uniform numbers are the leading 52 bits of an MD5 digest, so neighbouring places and replicates are
unrelated and every index below 2**52 is equally likely up to 2**-52 n.

`multinomial_sums` resamples rows through the counts of their distinct values: how often a value
of multiplicity k is drawn among the draws left is binomial, found by inverting its distribution
at the uniform of (replicate, value). The work grows with the distinct values, not with the rows.
`bootstrap_tails` draws the counts of ascending values in the same way and stops behind the order
statistics it needs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.functions.lineage import cut
from evq.functions.ordered import ordered_rank

BITS = 52
#: Distinct values that one task resamples; larger tables are cut into chunks with multinomial totals of their own.
CHUNK = 1 << 15
#: Replicates in one task.
BLOCK = 250
#: Half-width of an inverted binomial table in standard deviations; the mass beyond is under 1e-30.
WIDTH = 12.0


def uniform(rep: Column, place: Column) -> Column:
    """Number in [0, 1) of a replicate and a place."""
    digest = F.md5(F.concat(rep.cast("string"), F.lit(":"), place.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long") / F.lit(float(1 << BITS))


def draw(rep: Column, slot: Column, n: Column) -> Column:
    """Index in [0, n) for a replicate and slot counted from zero."""
    return F.floor(uniform(rep, slot) * n).cast("long")


def draws(spark: SparkSession, n: int, reps: int) -> DataFrame:
    """reps * n rows (rep, idx), generated in parallel; for tables bounded by a calendar."""
    ids = spark.range(reps * n)
    return ids.select(F.expr(f"id div {n}").alias("rep"), (F.col("id") % n).alias("slot")).select("rep", draw(F.col("rep"), F.col("slot"), F.lit(n).cast("long")).alias("idx"))


def _uniforms(reps: np.ndarray, place: object) -> np.ndarray:
    scale = 1 << BITS
    return np.array([int(hashlib.md5(f"{r}:{place}".encode()).hexdigest()[:BITS // 4], 16) / scale for r in reps.tolist()])


def _log_factorials(k: np.ndarray) -> np.ndarray:
    """ln k! by Stirling's series from 32 on and by products below."""
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 32)))))
    x = np.maximum(k, 32).astype(np.float64) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return np.where(k < 32, small[np.minimum(k, 31).astype(np.int64)], series)


def binomial_quantiles(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """Smallest k with P(Binomial(n, p) <= k) >= u, elementwise; one table per distinct n."""
    out = np.zeros(len(n), dtype=np.int64)
    if p <= 0:
        return out
    if p >= 1:
        return n.astype(np.int64)
    for m in np.unique(n).tolist():
        at = n == m
        half = WIDTH * math.sqrt(m * p * (1 - p)) + 60
        lo, hi = max(0, math.floor(m * p - half)), min(m, math.ceil(m * p + half))
        k = np.arange(lo, hi + 1)
        logs = _log_factorials(np.array([m]))[0] - _log_factorials(k) - _log_factorials(m - k) + k * math.log(p) + (m - k) * math.log1p(-p)
        out[at] = np.minimum(lo + np.searchsorted(np.cumsum(np.exp(logs)), u[at], side="left"), hi)
    return out


def multinomial_counts(sizes: Sequence[int], reps: np.ndarray, total: np.ndarray, label: str, until: np.ndarray | None = None) -> np.ndarray:
    """(len(sizes), len(reps)) counts of `total` draws over groups of the given sizes, one group after another.

    With `until` the counts end at the group by which every replicate has that many draws; later groups have no row.
    """
    left, rest = total.copy(), int(sum(sizes))
    out = np.zeros((len(sizes), len(reps)), dtype=np.int64)
    for i, k in enumerate(sizes):
        if i == len(sizes) - 1:
            out[i] = left
        elif k:
            out[i] = binomial_quantiles(left, k / rest, _uniforms(reps, f"{label}{i}"))
        left = left - out[i]
        rest -= int(k)
        if until is not None and (total - left >= until).all():
            return out[:i + 1]
    return out


def chunked(counts: DataFrame, values: list[str], reps: int, by: Sequence[str]) -> DataFrame:
    """Rows (by, values, n, _rn, _chunk, _sizes, _from): distinct values in order, cut into chunks, once for each block of replicates."""
    merged = counts.groupBy(*by, *values).agg(F.sum("n").cast("long").alias("n")).filter("n > 0")
    ranked = cut(ordered_rank(merged, list(by), values, "_rn").withColumn("_chunk", F.expr(f"cast((_rn - 1) div {CHUNK} as int)")))
    sizes = ranked.groupBy(*by, "_chunk").agg(F.sum("n").alias("_k"))
    totals = sizes.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_chunk", "_k"))), lambda s: s["_k"]).alias("_sizes"))
    starts = F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(BLOCK))).alias("_from")
    rows = ranked.join(totals, list(by)) if by else ranked.crossJoin(totals)
    return rows.select(*by, *values, "n", "_rn", "_chunk", "_sizes", starts)


def multinomial_sums(counts: DataFrame, values: list[str], reps: int, by: Sequence[str] = ()) -> DataFrame:
    """Bootstrap rows from the counts `n` of their distinct values, per group `by`.

    Result: by, rep, the sums of each value column, and n. Values are ordered and cut into chunks;
    a chunk's share of the draws comes from the multinomial over the chunk totals, which every task
    of a replicate finds alike.
    """
    rows = chunked(counts, values, reps, by)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by), "rep long", *(f"`{v}` double" for v in values), "n long"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        first, chunk = pdf.iloc[0], int(pdf["_chunk"].iloc[0])
        r = np.arange(first["_from"], min(reps, first["_from"] + BLOCK))
        sizes = [int(k) for k in first["_sizes"]]
        share = multinomial_counts(sizes, r, np.full(len(r), sum(sizes)), "chunk")[chunk]
        c = multinomial_counts(pdf["n"].tolist(), r, share, f"{chunk}/")
        out = pd.DataFrame({b: [first[b]] * len(r) for b in by} | {"rep": r})
        for v in values:
            out[v] = pdf[v].to_numpy(dtype=np.float64) @ c
        out["n"] = share
        return out

    parts = rows.groupBy(*by, "_chunk", "_from").applyInPandas(run, fields)
    return parts.groupBy(*by, "rep").agg(*[F.sum(v).alias(v) for v in values], F.sum("n").alias("n"))


def bootstrap_tails(counts: DataFrame, value: str, alphas: Sequence[float], reps: int, by: Sequence[str]) -> DataFrame:
    """(by, rep, alpha, v, e): the interpolated alpha quantile of each replicate and the mean of its values up to it.

    counts: distinct values with how often (`n`) each occurs. A replicate's counts are drawn over ascending values
    and end behind the order statistics of the largest alpha; chunks that lie behind them for all replicates
    draw nothing. Values between the two order statistics don't exist, so the tail is what is not above the lower one.
    """
    rows = chunked(counts, [value], reps, by)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by), "rep long, alpha double, _f double, _a double, _b double, _s double, _k long"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        first, chunk = pdf.iloc[0], int(pdf["_chunk"].iloc[0])
        r = np.arange(first["_from"], min(reps, first["_from"] + BLOCK))
        sizes = [int(k) for k in first["_sizes"]]
        n = sum(sizes)
        places = [((n - 1) * a, math.floor((n - 1) * a), min(math.floor((n - 1) * a) + 1, n - 1)) for a in alphas]
        last = max(hi for _, _, hi in places)
        shares = multinomial_counts(sizes, r, np.full(len(r), n), "chunk")
        below = shares[:chunk].sum(axis=0)
        if (below > last).all():
            return pd.DataFrame()
        parts = []
        c = multinomial_counts(pdf["n"].tolist(), r, shares[chunk], f"{chunk}/", last + 1 - below)
        x, upto, at = pdf[value].to_numpy(dtype=np.float64)[:len(c)], below + np.cumsum(c, axis=0), np.arange(len(r))
        sums = np.cumsum(c * x[:, None], axis=0)
        for alpha, (h, lo, hi) in zip(alphas, places, strict=True):
            here = [(below <= k) & (upto[-1] > k) for k in (lo, hi)]
            where = [np.argmax(upto > k, axis=0) for k in (lo, hi)]
            end = np.where(here[0], where[0], len(c) - 1)
            begun = below <= lo
            parts.append({
                "rep": r, "alpha": np.full(len(r), alpha), "_f": np.full(len(r), h - lo), "_a": np.where(here[0], x[where[0]], np.nan), "_b": np.where(here[1], x[where[1]], np.nan),
                "_s": np.where(begun, sums[end, at], 0.0), "_k": np.where(begun, upto[end, at] - below, 0)})
        out = {c: np.concatenate([p[c] for p in parts]) for c in ("rep", "alpha", "_f", "_a", "_b", "_s", "_k")}
        return pd.DataFrame({b: [first[b]] * len(out["rep"]) for b in by} | out)

    parts = rows.groupBy(*by, "_chunk", "_from").applyInPandas(run, fields)
    lo, hi = (F.max(F.when(~F.isnan(c), F.col(c))) for c in ("_a", "_b"))
    whole = parts.groupBy(*by, "rep", "alpha").agg(F.max("_f").alias("_f"), lo.alias("_a"), hi.alias("_b"), F.sum("_s").alias("_s"), F.sum("_k").alias("_k"))
    return whole.select(*by, "rep", "alpha", (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias("v"), (F.col("_s") / F.col("_k")).alias("e"))


def resample_rows(rows: DataFrame, idx: str, n: int, values: list[str], reps: int) -> DataFrame:
    """Bootstrap of indexed rows (idx from zero, dense), few enough to be a calendar: sums of each value per replicate."""
    d = draws(rows.sparkSession, n, reps)
    return d.join(rows.withColumnRenamed(idx, "idx"), "idx").groupBy("rep").agg(*[F.sum(v).alias(v) for v in values], F.count("*").alias("n"))


def interval(reps: DataFrame, stat: Column, observed: Column | None = None, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval of a replicate statistic; p-values if the observed value is given."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    r = reps.select(*by, stat.alias("_s"))
    aggs = [F.avg("_s").alias("boot_mean"), F.percentile("_s", F.lit(lo)).alias("ci_low"), F.percentile("_s", F.lit(hi)).alias("ci_high"),
            (2 * F.least(F.avg((F.col("_s") <= 0).cast("double")), F.avg((F.col("_s") >= 0).cast("double")))).alias("p_sign")]
    if observed is not None:
        aggs.append(F.avg((F.abs("_s") >= F.abs(observed)).cast("double")).alias("p_abs"))
    return r.groupBy(*by).agg(*aggs)
