"""Whole jobs composed of operators: decisions per scenario, the walk-forward benchmark, the risk report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.operators import evaluation as V
from evq.operators import features as X
from evq.operators import models as M
from evq.operators import portfolio as P
from evq.operators import risk as R
from evq.operators import signals as S
from evq.operators.asof import dense_returns
from evq.operators.events import realized_path

KEYS = ["industry_code", "event_date"]


def scenario_vectors(scn: DataFrame, panel: DataFrame, mkt: DataFrame, val: DataFrame, margin: DataFrame,
                     prior: DataFrame | None = None, factors: DataFrame | None = None) -> DataFrame:
    """Fusion inputs of every scenario; market features are built once per (industry, date).

    prior: (event_type, industry_code, signed_strength); factors: (event_id, signed_value).
    """
    feat = X.features(panel, mkt)
    keys = scn.select(*KEYS).distinct()
    state = S.momentum_prob(X.froth(X.valuation_snapshot(X.market_snapshot(keys, feat), val), margin), feat)
    rows = scn.join(state, KEYS)
    rows = rows.withColumn("irf_prior", F.lit(0.0)) if prior is None else rows.join(
        prior.select("event_type", "industry_code", F.col("signed_strength").alias("irf_prior")), ["event_type", "industry_code"], "left")
    if factors is None:
        rows = rows.withColumns({c: F.lit(0.0) for c in ("text_net", "text_bull_bear", "disagreement")})
    else:
        b = S.factor_balance(factors, ["event_id"]).select("event_id", F.col("net").alias("text_net"), F.col("net").alias("text_bull_bear"), "disagreement")
        rows = rows.join(b, "event_id", "left")
    return S.fusion_vector(rows.withColumns({"ts_prob_up": F.col("momentum_prob"), "ts_signal": F.col("momentum_20")}))


def predict(vectors: DataFrame, past: DataFrame) -> DataFrame:
    """Decision per scenario from raw scores and a type policy fitted on past rows (event_type, prob_up)."""
    scored = vectors.withColumn("prob_up", S.raw_score("fusion")).withColumns({"n_evidence": F.lit(1), "has_factors": F.lit(False)})
    return M.decide(scored, M.quantile_policy(past))


def walk_forward_benchmark(vectors: DataFrame, labels: DataFrame, keys: Sequence[str] = V.KEYS, max_train: int = 500) -> dict[str, DataFrame]:
    """Walk-forward probabilities, per-row thresholds, and their accuracy tables.

    labels: keys plus real_dir. Calibrators are refitted each quarter.
    """
    rows = vectors.join(labels.select(*keys, "real_dir"), list(keys)).withColumns(
        {"block": F.year("event_date") * 4 + F.quarter("event_date"), "label": (F.col("real_dir") == "+").cast("int")})
    order = ["event_date", *[k for k in keys if k != "event_date"]]
    p = M.walk_forward_score(rows, S.VECTOR, "label", S.raw_score(), "event_date", "block", order, max_train)
    p = p.withColumns({"confidence": F.abs(F.col("prob_up") - 0.5) * 2, "final_dir": F.when(F.col("prob_up") >= 0.5, "+").otherwise("-")})
    p = p.withColumn("dir_correct", F.col("final_dir") == F.col("real_dir"))
    p = M.selective_threshold(p).withColumn("abstain", F.col("confidence") < F.col("threshold"))
    return {"rows": p, "summary": V.summary(p), "curve": V.selective_curve(p), "by_class": V.class_accuracy(p, ["event_type"])}


def risk_report(results: DataFrame, panel: DataFrame, mkt: DataFrame, weights: DataFrame | None = None,
                shocks: Sequence[tuple[str, float, float]] = (), ranges: Sequence[tuple[str, str, str]] = (), as_of: str | None = None) -> dict[str, DataFrame]:
    """Portfolio, calibration, stress and attribution tables for prediction rows with a confidence."""
    feat, rets = X.features(panel, mkt), dense_returns(panel, mkt)
    w = P.resolve_weights(results, weights)
    real = realized_path(results.select("event_id", "event_date", "industry_code"), panel, mkt).drop("event_date")
    rows = P.vol_var(w, feat).join(real, ["event_id", "industry_code", "horizon"]).withColumn("pred_mdd", F.lit(None).cast("double"))
    iw = P.industry_weights(w)
    grid = R.risk_grid(P.portfolio_returns(rets, iw).withColumn("book", F.lit("all")), ["book"])
    cal = R.backtest_var(rows, ["horizon"])
    betas = P.beta_asof(results.select(*KEYS).distinct(), rets)
    attr = P.return_attribution(realized_path(results, panel, mkt, inclusive_end=False), betas, KEYS)
    out = {"portfolio": P.portfolio_view(rows), "industry": P.industry_view(rows), "calibration": cal, "risk": grid,
           "limits": P.check_limits(iw, cal, grid.filter("alpha = 0.05 and method = 'historical'")), "attribution": P.attribution_by(attr),
           "components": P.component_var(rets, iw), "top_losses": P.top_losses(rows, 10, ["event_date", "event_id", "industry_code"])}
    if shocks:
        day = F.lit(as_of).cast("date") if as_of else rets.agg(F.date_add(F.max("d"), 1)).scalar()
        out["synthetic"] = P.synthetic_stress(iw, P.beta_asof(iw.select("industry_code", day.alias("event_date")), rets), shocks)
    if ranges:
        out["historical"] = P.historical_stress(iw, rets, ranges)
    return out
