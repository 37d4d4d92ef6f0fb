"""Portfolio queries: weights, views, betas, stress, attribution (I16-I29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.functions.cols import r4, r6
from evq.operators import portfolio as P
from evq.operators import risk as R
from evq.operators.asof import dense_returns
from evq.operators.events import realized_path
from evq.plans.catalog import query

KEYS = ["event_id", "industry_code"]
IW = """iw AS (SELECT p_type AS industry_code, CAST(sum(p_size) AS DOUBLE) AS w FROM part WHERE p_type <> 'PROMO' GROUP BY 1)"""
WR = IW + """, wr AS (SELECT r.*, coalesce(w, 0) / sum(coalesce(w, 0)) OVER () AS weight FROM res0 r LEFT JOIN iw USING (industry_code)),
  wt AS (SELECT industry_code, sum(weight) AS weight FROM wr GROUP BY 1)"""
SYN = (("mild", -0.05, 1.0), ("hard", -0.10, 1.5))
HIS = (("autumn", "1997-09-01", "1997-12-31"), ("spring", "1999-02-01", "1999-05-31"), ("year", "2000-01-01", "2000-12-31"))


def ind_w(s):
    return s.t("part").filter("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("industry_code")).agg(F.sum("p_size").cast("double").alias("weight"))


def weighted(s):
    return P.resolve_weights(s.res(0), ind_w(s))


def rets(s):
    return dense_returns(s.px, s.mkt)


@query("i16_resolve_weights_industry", f"WITH {WR} SELECT event_id, industry_code, r6(weight * 1000) AS weight_k FROM wr")
def _(s):
    return weighted(s).select(*KEYS, r6(F.col("weight") * 1000).alias("weight_k"))


@query("i16_resolve_weights_event", """WITH w AS (SELECT event_date, industry_code, max(prob_up) AS w FROM res1 WHERE event_type = '1-URGENT' GROUP BY 1, 2)
  SELECT event_id, industry_code, r6(coalesce(w, 0) / sum(coalesce(w, 0)) OVER () * 1000) AS weight_k FROM res0 LEFT JOIN w USING (event_date, industry_code)""")
def _(s):
    w = s.res(1).filter("event_type = '1-URGENT'").groupBy("event_date", "industry_code").agg(F.max("prob_up").alias("weight"))
    return P.resolve_weights(s.res(0), w, ["event_date", "industry_code"]).select(*KEYS, r6(F.col("weight") * 1000).alias("weight_k"))


@query("i17_industry_weights", f"WITH {WR} SELECT industry_code, r6(weight) AS weight FROM wt")
def _(s):
    return P.industry_weights(weighted(s)).select("industry_code", r6("weight").alias("weight"))


@query("i17_committed_weights", "SELECT industry_code, r6(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)) AS weight FROM res0 WHERE NOT abstain GROUP BY 1")
def _(s):
    return P.committed_weights(s.res(0)).select("industry_code", r6("weight").alias("weight"))


VW = """wv AS (SELECT rr0.*, 1 / CAST(count(*) OVER (PARTITION BY horizon) AS DOUBLE) AS weight FROM rr0)"""
WM = "r6(sum({c} * weight) / sum(weight)) AS {a}"
VCOLS = ", ".join(WM.format(c=c, a=a) for a, c in P.VIEW.items())


def wrows(s):
    rr = s.risk_rows()
    # one row for each horizon of a fixed list: joined by shuffle, a third of all rows would meet in one task
    return rr.withColumn("weight", F.lit(1.0)).join(F.broadcast(rr.groupBy("horizon").agg(F.count("*").alias("_n"))), "horizon").withColumn("weight", 1.0 / F.col("_n"))


@query("i18_portfolio_view", f"WITH {VW} SELECT CAST(horizon AS INT) AS horizon, {VCOLS}, r6(sum(weight * weight) * 1000) AS hhi_k, r4(1 / sum(weight * weight)) AS effective_n, count(*) AS n FROM wv GROUP BY 1")
def _(s):
    v = P.portfolio_view(wrows(s))
    return v.select("horizon", *[r6(c).alias(c) for c in P.VIEW], r6(F.col("hhi") * 1000).alias("hhi_k"), r4("effective_n").alias("effective_n"), "n")


@query("i19_industry_view", f"WITH {VW} SELECT CAST(horizon AS INT) AS horizon, industry_code, r6(sum(weight)) AS weight, {VCOLS.replace("r6(", "r4(")}, count(*) AS n_events FROM wv GROUP BY 1, 2")
def _(s):
    v = P.industry_view(wrows(s))
    return v.select("horizon", "industry_code", r6("weight").alias("weight"), *[r4(c).alias(c) for c in P.VIEW], "n_events")


@query("i20_top_losses", "SELECT CAST(horizon AS INT) AS horizon, event_id, industry_code, realized_car, realized_mdd, CAST(row_number() OVER (PARTITION BY horizon ORDER BY realized_car, event_date, event_id, industry_code) AS INT) AS rank FROM rr0 QUALIFY rank <= 10")
def _(s):
    t = P.top_losses(s.risk_rows(), 10, ["event_date", "event_id", "industry_code"])
    return t.select("horizon", "event_id", "industry_code", "realized_car", "realized_mdd", "rank")


@query("i21_dispersion_stats", """WITH d AS (SELECT event_id, r6(stddev_pop(prob_up)) AS dispersion FROM res0 GROUP BY 1)
  SELECT r6(avg(dispersion)) AS mean, r6(quantile_cont(dispersion, 0.5)) AS p50, r6(quantile_cont(dispersion, 0.9)) AS p90, r6(max(dispersion)) AS max, count(dispersion) AS n FROM d""")
def _(s):
    d = s.res(0).groupBy("event_id").agg(r6(F.stddev_pop("prob_up")).alias("dispersion"))
    return P.dispersion_stats(d).select(*[r6(c).alias(c) for c in ("mean", "p50", "p90", "max")], "n")


PR = f"{WR}, pr AS (SELECT d, sum(weight * coalesce(r, 0)) AS r FROM ret JOIN wt USING (industry_code) GROUP BY 1)"


@query("i22_portfolio_returns", f"WITH {PR} SELECT d, r6(r) AS r FROM pr")
def _(s):
    return P.portfolio_returns(rets(s), P.industry_weights(weighted(s))).select("d", r6("r").alias("r"))


@query("i23_check_limits", f"""WITH {PR}, cal0 AS (SELECT horizon, avg(CAST(realized_car < pred_var AS INT)) AS br FROM rr0 GROUP BY 1),
  q AS (SELECT quantile_cont(r, 0.05) AS v FROM pr)
  SELECT 'single_industry_weight' AS kind, industry_code AS subject, r6(weight) AS value, 0.2::DOUBLE AS lim FROM wt WHERE weight > 0.2
  UNION ALL SELECT 'hhi', 'portfolio', r6(sum(weight * weight)), 0.1 FROM wt HAVING sum(weight * weight) > 0.1
  UNION ALL SELECT 'var_breach', CAST(horizon AS VARCHAR), r6(br / 0.05), 0.3 FROM cal0 WHERE br / 0.05 > 0.3
  UNION ALL SELECT 'portfolio_var_budget', CAST(h AS VARCHAR), r6(v * sqrt(h)), 0.1 FROM q CROSS JOIN (VALUES (1), (5), (20)) g(h) WHERE abs(v * sqrt(h)) > 0.1""")
def _(s):
    iw = P.industry_weights(weighted(s))
    cal = R.backtest_var(s.risk_rows(), ["horizon"])
    pv = R.risk_grid(P.portfolio_returns(rets(s), iw).withColumn("k", F.lit(1)), ["k"], (0.05,), ("historical",))
    return P.check_limits(iw, cal, pv, {"breach_warning_multiple": 0.3}).withColumn("value", r6("value"))


BETA = """bst AS (SELECT industry_code, d, CASE WHEN count(CASE WHEN r IS NOT NULL THEN m END) OVER w >= 18 THEN covar_samp(r, m) OVER w / nullif(var_samp(CASE WHEN r IS NOT NULL THEN m END) OVER w, 0) END AS b
   FROM ret WINDOW w AS (PARTITION BY industry_code ORDER BY d ROWS 59 PRECEDING)),
  bk AS (SELECT industry_code, event_date, max(d) AS d FROM probe JOIN ret USING (industry_code) WHERE d < event_date GROUP BY 1, 2),
  be AS (SELECT probe.industry_code, probe.event_date, coalesce(b, 1) AS beta, b IS NULL AS beta_fallback FROM probe LEFT JOIN bk USING (industry_code, event_date) LEFT JOIN bst ON bst.industry_code = probe.industry_code AND bst.d = bk.d)"""


@query("i24_beta_asof", f"WITH {BETA} SELECT event_id, industry_code, r6(beta) AS beta, beta_fallback FROM scn JOIN be USING (industry_code, event_date)")
def _(s):
    b = P.beta_asof(s.scn, rets(s))
    return b.select(*KEYS, r6("beta").alias("beta"), "beta_fallback")


LASTB = "lb AS (SELECT industry_code, arg_max(b, d) AS b FROM bst WHERE d < DATE '2000-12-31' GROUP BY 1)"


@query("i25_synthetic_stress", f"""WITH {WR}, {BETA}, {LASTB}, x AS (SELECT scenario, industry_code, weight, coalesce(b, 1) AS beta, coalesce(b, 1) * sh * mu AS shock FROM wt LEFT JOIN lb USING (industry_code)
  CROSS JOIN (VALUES ('mild', -0.05, 1.0), ('hard', -0.10, 1.5)) g(scenario, sh, mu))
  SELECT scenario, industry_code, r6(weight) AS weight, r6(beta) AS beta, r6(shock) AS shock, r6(weight * shock) AS pnl, r6(sum(weight * shock) OVER (PARTITION BY scenario)) AS portfolio_pnl,
   CAST(row_number() OVER (PARTITION BY scenario ORDER BY weight * shock, industry_code) AS INT) AS rank FROM x""")
def _(s):
    iw = P.industry_weights(weighted(s))
    as_of = iw.select("industry_code", F.lit("2000-12-31").cast("date").alias("event_date"))
    st = P.synthetic_stress(iw, P.beta_asof(as_of, rets(s)), SYN)
    return st.select("scenario", "industry_code", *[r6(c).alias(c) for c in ("weight", "beta", "shock", "pnl", "portfolio_pnl")], "rank")


@query("i26_historical_stress", f"""WITH {WR}, x AS (SELECT scenario, industry_code, exp(sum(ln(1 + coalesce(r, 0)))) - 1 AS ret, exp(sum(ln(1 + coalesce(m, 0)))) - 1 AS market_ret FROM ret
  JOIN (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in HIS)}) g(scenario, a, b) ON d BETWEEN a AND b GROUP BY 1, 2)
  SELECT scenario, industry_code, r6(ret) AS ret, r6(market_ret) AS market_ret, r6(weight * ret) AS pnl, r6(sum(weight * ret) OVER (PARTITION BY scenario)) AS portfolio_pnl,
   CAST(row_number() OVER (PARTITION BY scenario ORDER BY weight * ret, industry_code) AS INT) AS rank FROM x JOIN wt USING (industry_code)""")
def _(s):
    st = P.historical_stress(P.industry_weights(weighted(s)), rets(s), HIS)
    return st.select("scenario", "industry_code", *[r6(c).alias(c) for c in ("ret", "market_ret", "pnl", "portfolio_pnl")], "rank")


ATT = BETA + """, xp AS (SELECT industry_code, event_date, h AS horizon, exp(sum(ln((1 + coalesce(r, 0)) / (1 + coalesce(m, 0))))) - 1 AS car, exp(sum(ln(1 + coalesce(r, 0)))) - 1 AS ci, exp(sum(ln(1 + coalesce(m, 0)))) - 1 AS cm
    FROM probe JOIN anch USING (event_date) CROSS JOIN (VALUES (1), (5), (20)) g(h) JOIN ret USING (industry_code) WHERE day_idx BETWEEN t0_idx AND t0_idx + h - 1 GROUP BY 1, 2, 3 HAVING count(*) = any_value(h)),
  att AS (SELECT event_id, event_type, industry_code, CAST(horizon AS INT) AS horizon, car, (beta - 1) * cm AS mc, ci - beta * cm AS ir, car - (beta - 1) * cm - (ci - beta * cm) AS ea FROM scn JOIN xp USING (industry_code, event_date) JOIN be USING (industry_code, event_date))"""


def _attr(s):
    paths = realized_path(s.scn, s.px, s.mkt, inclusive_end=False)
    betas = P.beta_asof(s.scn.select("industry_code", "event_date").distinct(), rets(s))
    return P.return_attribution(paths, betas, ["industry_code", "event_date"])


@query("i27_return_attribution", f"WITH {ATT} SELECT event_id, industry_code, horizon, r6(car) AS realized_car, r6(mc) AS market_component, r6(ir) AS industry_relative, r6(ea) AS event_alpha FROM att")
def _(s):
    return _attr(s).select(*KEYS, "horizon", *[r6(c).alias(c) for c in ("realized_car", "market_component", "industry_relative", "event_alpha")])


@query("i28_attribution_by_type", f"WITH {ATT} SELECT horizon, event_type, count(*) AS n, r6(avg(car)) AS realized_car, r6(avg(mc)) AS market_component, r6(avg(ir)) AS industry_relative, r6(avg(ea)) AS event_alpha FROM att GROUP BY 1, 2")
def _(s):
    a = P.attribution_by(_attr(s))
    return a.select("horizon", "event_type", "n", *[r6(c).alias(c) for c in ("realized_car", "market_component", "industry_relative", "event_alpha")])


@query("i29_component_var", f"""WITH {WR}, f AS (SELECT industry_code, d, coalesce(r, 0) AS r FROM ret), c AS (SELECT a.industry_code AS i, b.industry_code AS j, covar_samp(a.r, b.r) AS cv FROM f a JOIN f b USING (d) GROUP BY 1, 2),
  v AS (SELECT i, sum(cv * wj.weight) AS cw, any_value(wi.weight) AS wi FROM c JOIN wt wj ON wj.industry_code = j JOIN wt wi ON wi.industry_code = i GROUP BY 1), pv AS (SELECT sqrt(sum(wi * cw)) AS vol FROM v)
  SELECT i AS industry_code, r6(wi) AS weight, r6(cw / vol * -1.6448536269514722 * sqrt(5)) AS marginal_var, r6(wi * cw / vol * -1.6448536269514722 * sqrt(5)) AS component_var,
   r6(abs(wi * cw) / sum(abs(wi * cw)) OVER ()) AS component_share, r6(vol * -1.6448536269514722 * sqrt(5)) AS portfolio_var FROM v, pv""")
def _(s):
    c = P.component_var(rets(s), P.industry_weights(weighted(s)))
    return c.select("industry_code", *[r6(x).alias(x) for x in ("weight", "marginal_var", "component_var", "component_share", "portfolio_var")])
