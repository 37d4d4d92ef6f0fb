"""Weights, portfolio views, betas, stress and attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.functions.cols import compound
from evq.functions.ordered import exact_quantiles
from evq.functions.windows import asof_join, trailing
from evq.operators.asof import FEATURE_COLS
from evq.operators.risk import Z

VIEW = {"realized_car": "realized_car", "realized_mdd": "realized_mdd", "realized_es": "realized_downside",
        "predicted_var": "pred_var", "predicted_mdd": "pred_mdd"}


def vol_var(rows: DataFrame, feat: DataFrame, scales: dict[int, float] = {1: 0.4, 5: -0.4, 20: -0.4}, lookback: int = 120,
            default_sigma: float = 0.01) -> DataFrame:
    """VaR from pre-event volatility, widened or narrowed by missing confidence; ES is 1.15 times VaR."""
    clean = feat.dropna(subset=list(FEATURE_COLS))
    sd = F.stddev_pop("ret").over(trailing(["industry_code"], "d", lookback))
    got = asof_join(rows, clean.select("industry_code", "d", sd.alias("sigma")), ["industry_code"], "event_date", "d", ["sigma"], settle=True)
    grid = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(float(s)).alias("sc")) for h, s in scales.items()]))
    long = got.withColumn("sigma", F.coalesce("sigma", F.lit(default_sigma))).withColumn("_g", grid)
    var = -1.645 * F.col("sigma") * F.sqrt(F.col("_g.horizon")) * (1 + F.col("_g.sc") * F.greatest(F.lit(0.0), 1 - F.col("confidence")))
    return long.select(*rows.columns, F.col("_g.horizon").alias("horizon"), var.alias("pred_var"), (1.15 * var).alias("pred_es"))


def resolve_weights(rows: DataFrame, weights: DataFrame | None = None, by: Sequence[str] = ("industry_code",)) -> DataFrame:
    """Row weights summing to one: equal, or looked up by industry or by (event_date, industry).

    Unlisted rows weigh zero; a zero total falls back to equal weights. Totals are
    distributed aggregates read back as scalar subqueries.
    """
    n = rows.agg(F.count("*")).scalar()
    if weights is None:
        return rows.withColumn("weight", 1.0 / n)
    raw = rows.join(weights.select(*by, F.col("weight").cast("double").alias("_w")), list(by), "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    tot = raw.agg(F.sum("_w")).scalar()
    return raw.withColumn("weight", F.when(tot > 0, F.try_divide(F.col("_w"), tot)).otherwise(1.0 / n)).drop("_w")


def industry_weights(rows: DataFrame) -> DataFrame:
    return rows.groupBy("industry_code").agg(F.sum("weight").alias("weight"))


def committed_weights(results: DataFrame) -> DataFrame:
    """Share of each industry among committed rows."""
    kept = results.filter(~F.col("abstain"))
    n = kept.agg(F.count("*")).scalar()
    return kept.groupBy("industry_code").agg((F.count("*") / n).alias("weight"))


def _wmean(c: str) -> Column:
    known = F.col(c).isNotNull()
    return F.when(F.max(known), F.sum(F.when(known, F.col(c) * F.col("weight"))) / F.greatest(
        F.sum(F.when(known, F.col("weight"))), F.lit(1e-12)))


def portfolio_view(rows: DataFrame) -> DataFrame:
    """Weighted means over known values, concentration and effective number, per horizon."""
    hhi = F.sum(F.col("weight") * F.col("weight"))
    return rows.groupBy("horizon").agg(*[_wmean(c).alias(a) for a, c in VIEW.items()], hhi.alias("hhi"),
                                       (1.0 / F.greatest(hhi, F.lit(1e-12))).alias("effective_n"), F.count("*").alias("n"))


def industry_view(rows: DataFrame) -> DataFrame:
    return rows.groupBy("horizon", "industry_code").agg(F.sum("weight").alias("weight"), *[_wmean(c).alias(a) for a, c in VIEW.items()],
                                                        F.count("*").alias("n_events"))


def top_losses(rows: DataFrame, n: int, keys: Sequence[str], value: str = "realized_car") -> DataFrame:
    """The n smallest values per horizon; the rank filter limits each map task to n rows."""
    w = Window.partitionBy("horizon").orderBy(value, *keys)
    return rows.filter(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def dispersion_stats(rows: DataFrame, value: str = "dispersion") -> DataFrame:
    q = exact_quantiles(rows, [], value, {"p50": 0.5, "p90": 0.9})
    a = rows.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.count(value).alias("n"))
    return a.join(q, F.lit(True))


def portfolio_returns(rets: DataFrame, weights: DataFrame) -> DataFrame:
    j = rets.join(weights, "industry_code")
    return j.groupBy("d").agg(F.sum(F.col("weight") * F.coalesce("r", F.lit(0.0))).alias("r"))


# fixed values: default limits
LIMITS = {"single_industry_weight": 0.20, "hhi_warning": 0.10, "breach_warning_multiple": 2.0, "portfolio_var_budget": 0.10}


def check_limits(weights: DataFrame, calibration: DataFrame, portfolio_var: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Warning rows (kind, subject, value, lim): concentration, breaches and VaR budget."""
    lim = {**LIMITS, **(limits or {})}

    def warn(df, kind, subject, value, limit):
        return df.select(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), value.cast("double").alias("value"), F.lit(float(limit)).alias("lim"))

    single = warn(weights.filter(F.col("weight") > lim["single_industry_weight"]), "single_industry_weight", F.col("industry_code"), F.col("weight"), lim["single_industry_weight"])
    total = weights.agg(F.sum(F.col("weight") * F.col("weight")).alias("v")).filter(F.col("v") > lim["hhi_warning"])
    mult = calibration.withColumn("v", F.try_divide(F.col("breach_rate"), F.col("expected_rate"))).filter(F.col("v") > lim["breach_warning_multiple"])
    budget = portfolio_var.filter(F.abs("var") > lim["portfolio_var_budget"])
    return (single.unionByName(warn(total, "hhi", F.lit("portfolio"), F.col("v"), lim["hhi_warning"]))
            .unionByName(warn(mult, "var_breach", F.col("horizon"), F.col("v"), lim["breach_warning_multiple"]))
            .unionByName(warn(budget, "portfolio_var_budget", F.col("horizon"), F.col("var"), lim["portfolio_var_budget"])))


def beta_state(rets: DataFrame, window: int = 60, min_pairs: int | None = None) -> DataFrame:
    """Rolling OLS beta at every trading day over the last `window` calendar rows."""
    w = trailing(["industry_code"], "d", window)
    need = max(10, int(window * 0.3)) if min_pairs is None else min_pairs
    both = F.col("r").isNotNull() & F.col("m").isNotNull()
    r, m = F.when(both, F.col("r")), F.when(both, F.col("m"))
    beta = F.try_divide(F.covar_samp(r, m).over(w), F.var_samp(m).over(w))
    ok = (F.count(m).over(w) >= need) & beta.isNotNull()
    return rets.select("industry_code", "d", F.when(ok, beta).alias("_b"))


def beta_asof(events: DataFrame, rets: DataFrame, window: int = 60, min_pairs: int | None = None) -> DataFrame:
    """Beta from rows strictly before each event; one with a fallback flag when history is short."""
    got = asof_join(events, beta_state(rets, window, min_pairs), ["industry_code"], "event_date", "d", ["_b"], settle=True)
    return got.withColumns({"beta": F.coalesce("_b", F.lit(1.0)), "beta_fallback": F.col("_b").isNull()}).drop("_b")


def _ranked_pnl(rows: DataFrame, worst: int) -> DataFrame:
    w = Window.partitionBy("scenario")
    return rows.withColumns({"portfolio_pnl": F.sum("pnl").over(w), "rank": F.row_number().over(w.orderBy("pnl", "industry_code"))}).filter(F.col("rank") <= worst)


def synthetic_stress(weights: DataFrame, betas: DataFrame, scenarios: Sequence[tuple[str, float, float]], worst: int = 10) -> DataFrame:
    """beta * shock * volatility multiplier per scenario (name, shock, multiplier) and industry."""
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(x)).alias("market_shock"), F.lit(float(v)).alias("mult")) for n, x, v in scenarios]))
    rows = weights.join(betas.select("industry_code", "beta"), "industry_code", "left").withColumn("beta", F.coalesce("beta", F.lit(1.0)))
    rows = rows.withColumn("s", s).select("industry_code", "weight", "beta", "s.*").withColumn("shock", F.col("beta") * F.col("market_shock") * F.col("mult"))
    return _ranked_pnl(rows.withColumn("pnl", F.col("weight") * F.col("shock")), worst)


def historical_stress(weights: DataFrame, rets: DataFrame, scenarios: Sequence[tuple[str, str, str]], worst: int = 10) -> DataFrame:
    """Compounded industry and market return between two dates (inclusive), and the portfolio loss."""
    s = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in scenarios])
    hit = rets.select("industry_code", "r", "m", F.explode(F.filter(s, lambda x: (F.col("d") >= x["a"]) & (F.col("d") <= x["b"]))).alias("s"))
    cum = hit.groupBy(F.col("s.scenario").alias("scenario"), "industry_code").agg(compound("r").alias("ret"), compound("m").alias("market_ret"))
    return _ranked_pnl(cum.join(weights, "industry_code").withColumn("pnl", F.col("weight") * F.col("ret")), worst)


def return_attribution(paths: DataFrame, betas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Split the active return into market, industry-relative and event parts (they add up)."""
    j = paths.join(betas.select(*keys, "beta", "beta_fallback"), list(keys))
    market = (F.col("beta") - 1) * F.col("market_cum")
    rel = F.col("industry_cum") - F.col("beta") * F.col("market_cum")
    return j.withColumns({"market_component": market, "industry_relative": rel, "event_alpha": F.col("realized_car") - market - rel})


def attribution_by(attr: DataFrame, by: str = "event_type") -> DataFrame:
    parts = ("realized_car", "market_component", "industry_relative", "event_alpha")
    return attr.groupBy("horizon", by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in parts])


def component_var(rets: DataFrame, weights: DataFrame, alpha: float = 0.05, horizon: int = 5) -> DataFrame:
    """Marginal and component VaR per industry.

    The covariance row times the weights equals the covariance with the portfolio's own
    return, so no industry pairs are formed.
    """
    filled = rets.select("industry_code", "d", F.coalesce("r", F.lit(0.0)).alias("r"))
    port = portfolio_returns(filled, weights).withColumnRenamed("r", "rp")
    cov = filled.join(port, "d").groupBy("industry_code").agg(F.covar_samp("r", "rp").alias("cov"))
    vol = port.agg(F.stddev_samp("rp")).scalar()
    zs = F.lit(Z[alpha] * horizon ** 0.5)
    rows = cov.join(weights, "industry_code", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    rows = rows.withColumn("marginal_var", F.coalesce(F.try_divide(F.col("cov"), vol), F.lit(0.0)) * zs)
    rows = rows.withColumn("component_var", F.col("weight") * F.col("marginal_var"))
    share = F.try_divide(F.abs("component_var"), F.sum(F.abs("component_var")).over(Window.partitionBy()))
    return rows.select("industry_code", "weight", "marginal_var", "component_var", F.coalesce(share, F.lit(0.0)).alias("component_share"), (vol * zs).alias("portfolio_var"))
