"""Forecast accuracy and strategy back-test metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.functions.cols import clip
from evq.functions.series import mean, total, variance


def forecast_metrics(paths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Error, direction, coverage and width over all steps of a group."""
    e = F.col("mean") - F.col("actual")

    def inside(k):
        return F.avg(((F.col("actual") >= F.col(f"lower_{k}")) & (F.col("actual") <= F.col(f"upper_{k}"))).cast("double"))

    return paths.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e / (F.abs("actual") + 1e-8))).alias("mape"), F.avg((F.signum("mean") == F.signum("actual")).cast("double")).alias("direction_acc"),
        inside(80).alias("coverage_80"), inside(95).alias("coverage_95"), F.avg(F.col("upper_95") - F.col("lower_95")).alias("width_95"))


def _cum(c: str, k: Column) -> Column:
    """Compounded return of the steps before k; a return of -1 or less gives -1."""
    keep = F.col("step") < k
    safe = F.when(F.col(c) > -1, F.col(c)).otherwise(F.lit(-1.0 + 1e-12))
    return F.exp(F.sum(F.when(keep, F.log1p(safe)))) - 1


def keypoint_direction(paths: DataFrame, by: Sequence[str], ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Sign agreement of compounded returns after k steps (k cut to the path length); zero counts as up."""
    aggs = []
    for k in ks:
        aggs += [_cum("mean", F.lit(k)).alias(f"p{k}"), _cum("actual", F.lit(k)).alias(f"a{k}")]
    g = paths.groupBy(*by).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("pred_cum"), F.col(f"a{k}").alias("actual_cum")) for k in ks]))
    return g.select(*by, rows.alias("r")).select(*by, "r.*").withColumn("dir_correct", (F.col("pred_cum") >= 0) == (F.col("actual_cum") >= 0))


def chain_quality(steps: DataFrame, chain: str) -> DataFrame:
    """Mean over chains of step confidence, evidence share and length."""
    per = steps.groupBy(chain).agg(F.avg(F.coalesce("confidence", F.lit(0.5))).alias("c"), F.avg((F.coalesce("n_evidence", F.lit(0)) > 0).cast("double")).alias("e"), F.count("*").alias("k"))
    return per.agg(F.count("*").alias("n_chains"), F.avg("c").alias("consistency"), F.avg("e").alias("evidence_coverage"), F.avg("k").alias("avg_length"))


def backtest(paths: DataFrame, by: Sequence[str], mode: str = "sign", cost: float = 0.001, slippage: float = 0.0005, typical: float = 0.005,
             stop: float = -0.03, risk_free: float = 0.02 / 252, signal: str = "mean", ret: str = "actual", costs: Sequence[float] | None = None) -> DataFrame:
    """Strategy result per forecast path (ordered by step), for one cost or a grid of costs.

    A path is a bounded array, so turnover, stop-loss and drawdown are folds over it.
    """
    rows = paths.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("step", F.col(signal).cast("double").alias("s"), F.col(ret).cast("double").alias("r")))).alias("_o"))
    rows = rows.select(*by, "_o", F.explode(F.array(*[F.lit(float(c)) for c in (costs or (cost,))])).alias("cost"))
    def pos(p):
        s = F.signum(p["s"])
        return s if mode == "sign" else s * clip(F.abs(p["s"]) / max(typical, 1e-8), 0, 1)

    start = F.struct(F.lit(0.0).alias("prev"), F.lit(0.0).alias("cum"), F.lit(False).alias("out"), F.array().cast("array<double>").alias("pnl"))

    def step(a, p):
        now = F.when(a["out"], 0.0).otherwise(pos(p))
        pnl = now * p["r"] - F.abs(now - a["prev"]) * (F.col("cost") + slippage)
        cum = a["cum"] + pnl
        out = a["out"] | (cum < stop) if mode == "stoploss" else F.lit(False)
        return F.struct(now.alias("prev"), cum.alias("cum"), out.alias("out"), F.concat(a["pnl"], F.array(pnl)).alias("pnl"))

    rows = rows.select(*by, "cost", F.aggregate("_o", start, step, lambda a: a["pnl"]).alias("pnl"))
    zero = F.struct(F.lit(1.0).alias("nav"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

    def nav(a, x):
        v = a["nav"] * (1 + x)
        peak = F.greatest(a["peak"], v)
        return F.struct(v.alias("nav"), peak.alias("peak"), F.greatest(a["dd"], (peak - v) / (peak + 1e-8)).alias("dd"))

    n = F.size("pnl")
    rows = rows.withColumn("_x", F.transform("pnl", lambda v: v - risk_free)).withColumn("_m", mean(F.col("_x")))
    rows = rows.withColumns({"_n": F.aggregate("pnl", zero, nav), "_sd": F.sqrt(variance(F.col("_x"), F.col("_m"), 0))})
    tot = F.col("_n.nav") - 1
    gains, losses = total(F.filter("pnl", lambda v: v > 0)), -total(F.filter("pnl", lambda v: v < 0))
    return rows.select(
        *by, "cost", n.alias("n"), tot.alias("total_return"), (F.pow(F.greatest(1 + tot, F.lit(1e-8)), 252 / F.greatest(n, F.lit(1))) - 1).alias("annual_return"),
        (F.col("_m") / (F.col("_sd") + 1e-8) * F.sqrt(F.lit(252.0))).alias("sharpe"), clip("_n.dd", 0, 1).alias("max_drawdown"),
        (F.size(F.filter("pnl", lambda v: v > 0)) / n).alias("win_rate"), (gains / (losses + 1e-8)).alias("profit_factor"))


def cost_grid(paths: DataFrame, by: Sequence[str], costs: Sequence[float] = (0.001, 0.002, 0.003), **kw) -> DataFrame:
    return backtest(paths, by, costs=costs, **kw)


def rolling_backtest(windows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rolling-origin accuracy: each window's forecast is its input mean held flat.

    Direction is judged on the first step only.
    """
    x = windows.withColumn("_f", mean(F.col("x")))
    err = F.transform("y", lambda v: F.abs(v - F.col("_f")))
    sq = F.transform("y", lambda v: (v - F.col("_f")) * (v - F.col("_f")))
    per = x.select(*by, total(err).alias("ae"), total(sq).alias("se"), F.size("y").alias("k"),
                   (F.signum("_f") == F.signum(F.get("y", 0))).cast("double").alias("d"))
    return per.groupBy(*by).agg(F.count("*").alias("n_windows"), (F.sum("ae") / F.sum("k")).alias("mae"), F.sqrt(F.sum("se") / F.sum("k")).alias("rmse"), F.avg("d").alias("direction_acc"))
