"""Value at risk, expected shortfall, event risk heads and VaR back-tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.functions.cols import clip
from evq.functions.ordered import ordered_lag
from evq.functions.resample import bootstrap_tails
from evq.functions.series import drawdown, mean, quantile, running, tail_mean, total, variance

# fixed values: standard normal quantiles
Z = {0.05: -1.6448536269514722, 0.01: -2.3263478740408408, 0.025: -1.9599639845400545, 0.1: -1.2815515655446004}
#: Forecast rows simulated at once.
SIMULATED_ROWS = 256
METHODS = ("historical", "bootstrap", "parametric", "ewma", "evt")


def series_arrays(rets: DataFrame, by: Sequence[str], value: str = "r", on: str = "d") -> DataFrame:
    """One row per series: its returns by date (_x) and ascending (_s), one shuffle for all methods."""
    rows = rets.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(on, value))).alias("_o"))
    x = F.transform("_o", lambda p: p[value].cast("double"))
    return rows.select(*by, x.alias("_x"), F.sort_array(x).alias("_s"))


def _normal(mu: Column, sigma: Column, alpha: float) -> tuple[Column, Column]:
    z = Z[alpha]
    return mu + z * sigma, mu - sigma * (math.exp(-z * z / 2) / (alpha * math.sqrt(2 * math.pi)))


def _staged(arr: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Moments the closed-form methods share, one projection per dependency level."""
    x, n = F.col("_x"), F.col("_n")
    df = arr.withColumn("_n", F.size("_x")).withColumn("_mu", mean(x))
    if "parametric" in methods:
        df = df.withColumn("_sd", F.sqrt(variance(x, F.col("_mu"), 1)))
    if "ewma" in methods:
        w = F.transform(x, lambda r, i: F.pow(F.lit(0.94), (n - 1 - i).cast("double")))
        df = df.withColumn("_w", w).withColumn("_q", F.zip_with("_x", "_w", lambda r, k: (r - F.col("_mu")) * (r - F.col("_mu")) * k))
        df = df.withColumn("_ew", F.sqrt(F.try_divide(total(F.col("_q")), total(F.col("_w"))))).drop("_w", "_q")
    if "evt" in methods:
        df = df.withColumn("_thr", -quantile(F.col("_s"), 0.1))
        df = df.withColumn("_ex", F.transform(F.filter(x, lambda r: -r > F.col("_thr")), lambda r: -r - F.col("_thr")))
        df = df.withColumn("_k", F.size("_ex").cast("double")).withColumn("_m", mean(F.col("_ex")))
        df = df.withColumn("_v", variance(F.col("_ex"), F.col("_m"), 1)).drop("_ex")
        df = df.withColumn("_ratio", F.try_divide(F.col("_m") * F.col("_m"), F.col("_v")))
    return df


def var_es_columns(method: str, alpha: float, textbook: bool = False) -> tuple[Column, Column]:
    """VaR and ES columns over the staged moments; _h holds the historical quantile of alpha."""
    n, mu = F.col("_n"), F.col("_mu")
    hist, hist_es = F.col(f"_h{alpha}".replace(".", "_")), F.col(f"_e{alpha}".replace(".", "_"))
    if method == "historical":
        return hist, hist_es
    if method in ("parametric", "ewma"):
        v, e = _normal(mu, F.col("_sd" if method == "parametric" else "_ew"), alpha)
        return F.when(n < 2, hist).otherwise(v), F.when(n < 2, hist_es).otherwise(e)
    if method == "evt":
        thr, m, ratio = F.col("_thr"), F.col("_m"), F.col("_ratio")
        shape = (0.5 * (1 - ratio)) if textbook else (0.5 * (ratio - 1))
        scale = 0.5 * m * (ratio + 1)
        tail = n / F.col("_k") * alpha
        flat = F.abs(shape) < 1e-6
        lv = F.when(flat, thr - scale * F.ln(tail)).otherwise(thr + F.try_divide(scale, shape) * (F.pow(tail, -shape) - 1))
        le = F.when(flat, lv + scale).otherwise(F.try_divide(lv + scale - shape * thr, 1 - shape))
        ok = (n >= 30) & (F.col("_k") >= 10) & (F.col("_v") > 1e-12) & (m > 0)
        return F.when(ok, -lv).otherwise(hist), F.when(ok, -le).otherwise(hist_es)
    raise ValueError(f"unknown method {method}")


def var_es(rets: DataFrame, by: Sequence[str], method: str = "historical", alpha: float = 0.05, value: str = "r",
           on: str = "d", reps: int = 1000) -> DataFrame:
    """VaR and ES of each return series by one method."""
    return risk_grid(rets, by, (alpha,), (method,), (1,), value, on, reps).drop("alpha", "method", "horizon")


def risk_grid(rets: DataFrame, by: Sequence[str], alphas: Sequence[float] = (0.05, 0.01), methods: Sequence[str] = METHODS,
              horizons: Sequence[int] = (1, 5, 20), value: str = "r", on: str = "d", reps: int = 1000) -> DataFrame:
    """Every alpha and method per series from one grouped array, scaled by the root of the horizon.

    The bootstrap averages the VaR and ES of the replicates, whose tails come from counts of distinct returns.
    """
    closed = [m for m in methods if m != "bootstrap"]
    parts = []
    for a in alphas:
        for m in closed:
            v, e = var_es_columns(m, a)
            parts.append(F.struct(F.lit(a).alias("alpha"), F.lit(m).alias("method"), v.alias("var"), e.alias("es")))
    out = None
    if parts:
        df = _staged(series_arrays(rets, by, value, on), closed)
        for a in alphas:
            k = f"{a}".replace(".", "_")
            df = df.withColumn(f"_h{k}", quantile(F.col("_s"), a)).withColumn(f"_e{k}", tail_mean(F.col("_s"), F.col(f"_h{k}")))
        out = df.select(*by, F.explode(F.array(*parts)).alias("g")).select(*by, "g.*")
    if "bootstrap" in methods:
        counts = rets.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("n"))
        each = bootstrap_tails(counts, "_v", list(alphas), reps, list(by))
        boot = each.groupBy(*by, "alpha").agg(F.avg("v").alias("var"), F.avg("e").alias("es")).withColumn("method", F.lit("bootstrap"))
        out = boot if out is None else out.unionByName(boot)
    h = F.explode(F.array(*[F.lit(k) for k in horizons])).alias("horizon")
    return out.select(*by, "alpha", "method", h, "var", "es").select(
        *by, "alpha", "method", "horizon", (F.col("var") * F.sqrt("horizon")).alias("var"), (F.col("es") * F.sqrt("horizon")).alias("es"))


def path_arrays(paths: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """First k steps of each forecast path as ordered arrays."""
    rows = paths.filter(F.col("step") < k).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("step", "mean", "lower_95", "upper_95"))).alias("_o"))
    return rows.select(*by, F.col("_o.mean").alias("_p"), F.col("_o.lower_95").alias("_lo"), F.col("_o.upper_95").alias("_hi"))


def max_drawdown(cum: Column) -> Column:
    """Drawdown of a cumulative-return path, starting from a peak of one."""
    return clip(drawdown(F.transform(cum, lambda c: 1.0 + c)), 0, 1)


def _simulate(n_paths: int):
    """Expected drawdown and breach probability; rows of one path length are simulated together, each from its own seed."""

    @F.pandas_udf("mdd double, breach double")
    def simulate(point: pd.Series, sigma: pd.Series, floor: pd.Series, seed: pd.Series) -> pd.DataFrame:
        sizes = point.map(len).to_numpy()
        mdd, sd, total_ = np.zeros(len(point)), np.zeros(len(point)), np.zeros(len(point))
        for k in np.unique(sizes):
            rows = np.flatnonzero(sizes == k)
            for part in np.array_split(rows, -(-len(rows) // SIMULATED_ROWS)):
                p, s = np.stack(point.iloc[part].to_numpy()).astype(float), np.stack(sigma.iloc[part].to_numpy()).astype(float)
                z = np.stack([np.random.default_rng(int(x) & 0x7FFFFFFFFFFFFFFF).standard_normal((n_paths, k)) for x in seed.iloc[part]])
                nav = 1 + np.cumsum(p[:, None, :] + s[:, None, :] * z, axis=2)
                peak = np.maximum(np.maximum.accumulate(nav, axis=2), 1)
                mdd[part] = np.clip(((peak - nav) / np.maximum(peak, 1e-12)).max(axis=2, initial=0), 0, 1).mean(axis=1)
                sd[part], total_[part] = np.sqrt((s**2).sum(axis=1)), p.sum(axis=1)
        gap = floor.to_numpy() - total_
        tail = np.array([0.5 * math.erfc(-g / (d * math.sqrt(2))) if d > 0 else float(g >= 0) for g, d in zip(gap, sd)])
        return pd.DataFrame({"mdd": mdd, "breach": tail})

    return simulate


def event_risk(paths: DataFrame, by: Sequence[str], k: int = 5, alpha: float = 0.05, dispersion: Column | None = None,
               method: str = "simulation", n_paths: int = 2000) -> DataFrame:
    """Risk of the cumulative forecast at step k.

    The sum of independent normal steps is normal, so VaR, CVaR and the interval are
    closed form; only the expected drawdown simulates paths, in Arrow batches.
    """
    arr = path_arrays(paths, by, k)
    disp = F.greatest(F.lit(0.0) if dispersion is None else dispersion, F.lit(0.0))
    lo, hi = total(F.col("_lo")), total(F.col("_hi"))
    tail = F.least(F.lit(0.5), alpha * (1 + disp))
    nav = F.transform(running(F.col("_p")), lambda c: 1.0 + c)
    if method == "legacy":
        return arr.select(*by, lo.alias("event_var"), lo.alias("cvar"), clip(drawdown(nav, eps=1e-8), 0, 1).alias("expected_mdd"),
                          tail.alias("tail_prob"), lo.alias("risk_lo"), hi.alias("risk_hi"))
    sig = F.transform(F.zip_with("_lo", "_hi", lambda a, b: F.abs(b - a) / 3.92), lambda v: v * (1 + disp))
    mu = total(F.col("_p"))
    sd = F.sqrt(total(F.transform(sig, lambda v: v * v)))
    v, e = _normal(mu, sd, alpha)
    edge = Z[alpha / 2] * sd
    sim = _simulate(n_paths)(F.col("_p"), F.col("_sig"), F.col("_l"), F.xxhash64(*by))
    out = arr.select(*by, v.alias("event_var"), e.alias("cvar"), (mu + edge).alias("risk_lo"), (mu - edge).alias("risk_hi"),
                     tail.alias("_t"), "_p", sig.alias("_sig"), lo.alias("_l")).withColumn("_m", sim)
    return out.select(*by, "event_var", "cvar", F.col("_m.mdd").alias("expected_mdd"), F.col("_m.breach").alias("prob_breach"),
                      F.least(F.lit(0.5), F.greatest(F.col("_m.breach"), F.col("_t"))).alias("tail_prob"), "risk_lo", "risk_hi")


def _ll(n: Column, p: Column) -> Column:
    return n * F.ln(clip(p, 1e-12, 1 - 1e-12))


def kupiec_lr(n: Column, breaches: Column, alpha: float) -> Column:
    pi = F.try_divide(breaches.cast("double"), n.cast("double"))
    a = F.lit(alpha)
    null = _ll(n - breaches, 1 - a) + _ll(breaches, a)
    alt = _ll(n - breaches, 1 - pi) + _ll(breaches, pi)
    return F.when(n == 0, 0.0).otherwise(-2 * (null - alt))


def chi2_tail(lr: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom, for the few aggregated rows."""
    @F.pandas_udf("double")
    def sf(s: pd.Series) -> pd.Series:
        return s.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)) if v == v else None)

    return sf(lr)


def kupiec(bt: DataFrame, by: Sequence[str], alpha: float = 0.05, realized: str = "realized_car", pred: str = "pred_var") -> DataFrame:
    """Breach counts and the unconditional-coverage test per group."""
    b = (F.col(realized) < F.col(pred)).cast("long")
    g = bt.filter(F.col(realized).isNotNull() & F.col(pred).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(b).alias("n_breach"))
    g = g.withColumn("kupiec_lr", kupiec_lr(F.col("n"), F.col("n_breach"), alpha))
    return g.withColumn("kupiec_p", chi2_tail(F.col("kupiec_lr")))


def christoffersen(bt: DataFrame, by: Sequence[str], order: Sequence[str], realized: str = "realized_car", pred: str = "pred_var") -> DataFrame:
    """Independence test on breach transitions in the given total order."""
    rows = bt.filter(F.col(realized).isNotNull() & F.col(pred).isNotNull()).select(
        *by, *order, (F.col(realized) < F.col(pred)).cast("int").alias("_b"))
    seq = ordered_lag(rows, by, order, "_b")

    def cnt(a, b):
        return F.coalesce(F.sum(((F.col("prev") == a) & (F.col("_b") == b)).cast("long")), F.lit(0)).alias(f"n{a}{b}")

    g = seq.groupBy(*by).agg(cnt(0, 0), cnt(0, 1), cnt(1, 0), cnt(1, 1))
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    p01, p11 = n01 / F.greatest(n00 + n01, F.lit(1)), n11 / F.greatest(n10 + n11, F.lit(1))
    pi = (n01 + n11) / F.greatest(n00 + n01 + n10 + n11, F.lit(1))
    null = _ll(n00 + n10, 1 - pi) + _ll(n01 + n11, pi)
    alt = _ll(n00, 1 - p01) + _ll(n01, p01) + _ll(n10, 1 - p11) + _ll(n11, p11)
    lr = F.when((pi == 0) | (pi == 1), 0.0).otherwise(-2 * (null - alt))
    return g.withColumn("christoffersen_lr", lr).withColumn("christoffersen_p", chi2_tail(F.col("christoffersen_lr")))


def pinball(realized: str, pred: str, alpha: float) -> Column:
    d = F.col(realized) - F.col(pred)
    return F.when(d >= 0, alpha * d).otherwise((alpha - 1) * d)


def backtest_var(bt: DataFrame, by: Sequence[str], alpha: float = 0.05, realized: str = "realized_car", pred: str = "pred_var",
                 realized_mdd: str | None = "realized_mdd", pred_mdd: str | None = "pred_mdd", order: Sequence[str] | None = None) -> DataFrame:
    """Pooled VaR back-test per group in one grouped pass; independence only if an order is given."""
    rows = bt.filter(F.col(realized).isNotNull() & F.col(pred).isNotNull())
    aggs = [F.count("*").alias("n"), F.sum((F.col(realized) < F.col(pred)).cast("long")).alias("n_breach"),
            F.avg(pinball(realized, pred, alpha)).alias("pinball_loss")]
    if realized_mdd and pred_mdd:
        aggs.append(F.avg(F.abs(F.col(realized_mdd) - F.col(pred_mdd))).alias("mdd_mae"))
    g = rows.groupBy(*by).agg(*aggs).withColumns({"breach_rate": F.col("n_breach") / F.col("n"), "expected_rate": F.lit(alpha)})
    g = g.withColumn("kupiec_lr", kupiec_lr(F.col("n"), F.col("n_breach"), alpha)).withColumn("kupiec_p", chi2_tail(F.col("kupiec_lr")))
    g = g.withColumn("passes_kupiec", F.col("kupiec_p") > 0.05)
    if order:
        c = christoffersen(rows, by, order, realized, pred).drop("n00", "n01", "n10", "n11")
        g = g.join(c, list(by)) if by else g.join(c, F.lit(True))
    return g


def var_matrix(bt: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Back-test per config and seed, plus the mean over seeds as seed = null."""
    cell = backtest_var(bt, ["config", "seed"], alpha)
    cols = ("breach_rate", "kupiec_lr", "pinball_loss", "mdd_mae")
    mean_rows = cell.groupBy("config").agg(F.lit(None).cast("int").alias("seed"), *[F.avg(c).alias(c) for c in cols])
    return cell.select("config", "seed", *cols).unionByName(mean_rows)


def compare_var(a: DataFrame, b: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Two VaR predictions on the same rows, back-tested side by side per horizon."""
    j = a.select(*keys, "realized_car", F.col("pred_var").alias("_a")).join(b.select(*keys, F.col("pred_var").alias("_b")), list(keys))
    long = j.select(*keys, "realized_car", F.expr("stack(2, 'candidate', _a, 'legacy', _b) as (source, pred_var)"))
    return backtest_var(long, ["horizon", "source"], alpha, realized_mdd=None)
