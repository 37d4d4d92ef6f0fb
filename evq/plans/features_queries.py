"""Feature queries (C rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.functions.cols import r4, r6
from evq.operators import features as X
from evq.operators.asof import calendar
from evq.plans.asof_queries import CLEAN, feat
from evq.plans.catalog import query

CODES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
HIGH = ("there", "thousand", "tion", "eaux")
NEG = ("leux", "hound")


def rounded(df, keep, six=(), four=()):
    return df.select(*keep, *[r6(c).alias(c) for c in six], *[r4(c).alias(c) for c in four])


def asof_sql(state: str, cols: str, keys: str = "industry_code", date: str = "d") -> str:
    """Strict as-of lookup by a lateral style max: state rows with date < event_date."""
    return f"""k AS (SELECT industry_code, event_date, max({date}) AS {date} FROM probe JOIN {state} USING (industry_code) WHERE {date} < event_date GROUP BY 1, 2)
      SELECT event_id, scn.industry_code, {cols} FROM scn LEFT JOIN k USING (industry_code, event_date) LEFT JOIN {state} s ON s.industry_code = scn.industry_code AND s.{date} = k.{date}"""


def global_asof_sql(state: str, cols: str) -> str:
    return f"""k AS (SELECT event_date, max(d) AS d FROM (SELECT DISTINCT event_date FROM ev) e JOIN {state} ON d < event_date GROUP BY 1)
      SELECT event_id, event_date, {cols} FROM ev LEFT JOIN k USING (event_date) LEFT JOIN {state} s ON s.d = k.d"""


@query("c1_returns", "SELECT industry_code, d, r6(ret) AS ret, r6(vol_chg) AS vol_chg FROM feat")
def _(s):
    return rounded(X.returns(s.px), ["industry_code", "d"], ["ret", "vol_chg"])


@query("c2_c3_c4_features", "SELECT industry_code, d, r6(mkt_ret) AS mkt_ret, r6(volatility) AS volatility, r6(ma5_gap) AS ma5_gap, r6(ma20_gap) AS ma20_gap FROM feat")
def _(s):
    return rounded(feat(s), ["industry_code", "d"], ["mkt_ret", "volatility", "ma5_gap", "ma20_gap"])


MSTATE = """b AS (SELECT * FROM feat WHERE ret IS NOT NULL AND mkt_ret IS NOT NULL),
 st AS (SELECT industry_code, d, sum(ret) OVER n AS momentum_20, sum(ret) OVER n - sum(mkt_ret) OVER n AS relative_strength_20, stddev_pop(volatility) OVER n + 1e-8 AS recent_vol,
   stddev_pop(ret) OVER f + 1e-8 AS hist_vol, CASE WHEN count(*) OVER f >= 20 THEN avg(vol_chg) OVER n ELSE 0 END AS volume_trend,
   coalesce(ma5_gap, 0) AS ma5_gap, coalesce(ma20_gap, 0) AS ma20_gap, count(*) OVER f AS n_hist FROM b
   WINDOW n AS (PARTITION BY industry_code ORDER BY d ROWS 19 PRECEDING), f AS (PARTITION BY industry_code ORDER BY d ROWS 249 PRECEDING))"""


@query("c5_market_snapshot", f"WITH {MSTATE}, " + asof_sql("st", """r6(momentum_20) AS momentum_20, r6(relative_strength_20) AS relative_strength_20, r6(recent_vol) AS recent_vol, r6(hist_vol) AS hist_vol,
   r4(recent_vol / hist_vol - 1) AS vol_regime, r6(volume_trend) AS volume_trend, r6(ma5_gap) AS ma5_gap, r6(ma20_gap) AS ma20_gap, n_hist"""))
def _(s):
    m = X.market_snapshot(s.scn, feat(s))
    return rounded(m, ["event_id", "industry_code", "n_hist"], [c for c in X.MARKET if c not in ("n_hist", "vol_regime")], ["vol_regime"])


VSTATE = """n AS (SELECT *, row_number() OVER o AS n_hist, lag(pe_ttm, 20) OVER o AS pe20 FROM val WINDOW o AS (PARTITION BY industry_code ORDER BY d)),
 st AS (SELECT a.industry_code, a.d, a.n_hist, a.pe_ttm AS pe_now, a.pb AS pb_now, a.dividend_yield, a.pe20, avg(CASE WHEN b.pe_ttm < a.pe_ttm THEN 1.0 ELSE 0.0 END) AS pe_p,
   avg(CASE WHEN b.pb < a.pb THEN 1.0 ELSE 0.0 END) AS pb_p FROM n a JOIN n b ON a.industry_code = b.industry_code AND b.d <= a.d GROUP BY ALL)"""


@query("c6_valuation_snapshot", f"WITH {VSTATE}, v AS (SELECT * FROM st WHERE n_hist >= 60), " + asof_sql("st", """
  CASE WHEN n_hist >= 60 THEN r6(pe_now) END AS pe_now, CASE WHEN n_hist >= 60 THEN r6(pe_p) END AS pe_percentile, CASE WHEN n_hist >= 60 THEN r6(-(pe_p - 0.5) * 2) END AS valuation_signal,
  CASE WHEN n_hist >= 60 THEN r6(abs(pe_p - 0.5) * 2) END AS valuation_confidence, CASE WHEN n_hist >= 60 THEN r6(pb_p) END AS pb_percentile, CASE WHEN n_hist >= 60 THEN r6(dividend_yield) END AS dividend_yield"""))
def _(s):
    return rounded(X.valuation_snapshot(s.scn, s.val), ["event_id", "industry_code"],
                   ["pe_now", "pe_percentile", "valuation_signal", "valuation_confidence", "pb_percentile", "dividend_yield"])


@query("c7_valuation_probe", f"WITH {VSTATE}, " + asof_sql("st", """coalesce(n_hist, 0) AS n_hist,
  r6(CASE WHEN n_hist >= 60 THEN pe_p ELSE 0.5 END) AS pe_percentile, r6(CASE WHEN n_hist >= 60 THEN pb_p ELSE 0.5 END) AS pb_percentile,
  r6(CASE WHEN n_hist >= 60 THEN pe_now / pe20 - 1 ELSE 0 END) AS pe_momentum_20, r6(CASE WHEN n_hist >= 60 THEN -(pe_p - 0.5) * 2 ELSE 0 END) AS valuation_signal"""))
def _(s):
    return rounded(X.valuation_probe(s.scn, s.val), ["event_id", "industry_code", "n_hist"],
                   ["pe_percentile", "pb_percentile", "pe_momentum_20", "valuation_signal"])


FSTATE = """m AS (SELECT d, total_fin / lag(total_fin, 20) OVER (ORDER BY d) - 1 AS mom, row_number() OVER (ORDER BY d) AS k FROM margin),
 st AS (SELECT a.d, a.mom, a.k, count(b.mom) AS h, avg(CASE WHEN b.mom < a.mom THEN 1.0 ELSE 0.0 END) FILTER (b.mom IS NOT NULL) AS p
   FROM m a JOIN m b ON b.k BETWEEN a.k - 249 AND a.k GROUP BY 1, 2, 3)"""


@query("c8_froth", f"WITH {FSTATE}, " + global_asof_sql("st", """r6(CASE WHEN k >= 50 AND h >= 20 THEN mom END) AS margin_momentum_20, r6(CASE WHEN k >= 50 AND h >= 20 THEN 2 * p - 1 END) AS froth"""))
def _(s):
    return rounded(X.froth(s.ev, s.margin), ["event_id", "event_date"], ["margin_momentum_20", "froth"])


@query("c9_macro_snapshot", "WITH st AS (SELECT d, row_number() OVER (ORDER BY d) AS macro_n, rate_1, rate_2, rate_1 - lag(rate_1) OVER (ORDER BY d) AS c1, rate_2 - lag(rate_2) OVER (ORDER BY d) AS c2 FROM rates), "
       + global_asof_sql("st", "macro_n, r6(rate_1) AS rate_1, r6(rate_2) AS rate_2, r6(c1) AS rate_1_chg, r6(c2) AS rate_2_chg"))
def _(s):
    return rounded(X.macro_snapshot(s.ev, s.rates), ["event_id", "event_date", "macro_n"], ["rate_1", "rate_2", "rate_1_chg", "rate_2_chg"])


@query("c11_build_features", f"""WITH {MSTATE.replace('st AS', 'ms AS')}, {VSTATE.replace('st AS', 'vs AS').replace('n AS (', 'vn AS (').replace('FROM n a JOIN n b', 'FROM vn a JOIN vn b')},
  {FSTATE.replace('st AS', 'fs AS').replace('m AS (', 'fm AS (', 1).replace('FROM m a JOIN m b', 'FROM fm a JOIN fm b')},
  rs AS (SELECT d, row_number() OVER (ORDER BY d) AS macro_n, rate_1 FROM rates),
  km AS (SELECT industry_code, event_date, max(d) AS d FROM probe JOIN ms USING (industry_code) WHERE d < event_date GROUP BY 1, 2),
  kv AS (SELECT industry_code, event_date, max(d) AS d FROM probe JOIN vs USING (industry_code) WHERE d < event_date GROUP BY 1, 2),
  e AS (SELECT DISTINCT event_date FROM ev), kf AS (SELECT event_date, max(d) AS d FROM e JOIN fs ON d < event_date GROUP BY 1), kr AS (SELECT event_date, max(d) AS d FROM e JOIN rs ON d < event_date GROUP BY 1)
  SELECT event_id, scn.industry_code, r6(momentum_20) AS momentum_20, CASE WHEN vs.n_hist >= 60 THEN r6(pe_p) END AS pe_percentile, r6(CASE WHEN fs.k >= 50 AND h >= 20 THEN 2 * p - 1 END) AS froth, r6(rate_1) AS rate_1,
    coalesce(macro_n, CASE WHEN fs.k >= 50 AND h >= 20 THEN fs.k END, CASE WHEN vs.n_hist >= 60 THEN vs.n_hist END, ms.n_hist) AS n_hist
  FROM scn LEFT JOIN km USING (industry_code, event_date) LEFT JOIN ms ON ms.industry_code = scn.industry_code AND ms.d = km.d
  LEFT JOIN kv ON kv.industry_code = scn.industry_code AND kv.event_date = scn.event_date LEFT JOIN vs ON vs.industry_code = scn.industry_code AND vs.d = kv.d
  LEFT JOIN kf ON kf.event_date = scn.event_date LEFT JOIN fs ON fs.d = kf.d LEFT JOIN kr ON kr.event_date = scn.event_date LEFT JOIN rs ON rs.d = kr.d""")
def _(s):
    b = X.build_features(s.scn, feat(s), s.val, s.margin, s.rates)
    return rounded(b, ["event_id", "industry_code", "n_hist"], ["momentum_20", "pe_percentile", "froth", "rate_1"])


@query("c12_baseline_features", """WITH i0 AS (SELECT *, ln(close) - ln(lag(close) OVER o) AS lr, row_number() OVER o AS k FROM px WINDOW o AS (PARTITION BY industry_code ORDER BY d)),
 st AS (SELECT industry_code, d, k, coalesce(close / lag(close, 5) OVER o - 1, 0) AS i5, coalesce(close / lag(close, 20) OVER o - 1, 0) AS i20,
   CASE WHEN k >= 21 THEN stddev_pop(lr) OVER w20 ELSE 0 END AS vol20, coalesce((close - min(close) OVER w60) / nullif(max(close) OVER w60 - min(close) OVER w60, 0), 0.5) AS pos60,
   CASE WHEN k >= 20 THEN avg(volume) OVER w5 / avg(volume) OVER w20 - 1 ELSE 0 END AS vtrend FROM i0 WINDOW o AS (PARTITION BY industry_code ORDER BY d),
   w5 AS (PARTITION BY industry_code ORDER BY d ROWS 4 PRECEDING), w20 AS (PARTITION BY industry_code ORDER BY d ROWS 19 PRECEDING), w60 AS (PARTITION BY industry_code ORDER BY d ROWS 59 PRECEDING)),
 mm AS (SELECT d, row_number() OVER (ORDER BY d) AS mk, coalesce(mkt_close / lag(mkt_close, 5) OVER (ORDER BY d) - 1, 0) AS m5, coalesce(mkt_close / lag(mkt_close, 20) OVER (ORDER BY d) - 1, 0) AS m20 FROM mkt),
 ka AS (SELECT industry_code, event_date, max(d) AS d FROM probe JOIN st USING (industry_code) WHERE d < event_date GROUP BY 1, 2),
 kb AS (SELECT event_date, max(d) AS d FROM (SELECT DISTINCT event_date FROM ev) JOIN mm ON d < event_date GROUP BY 1),
 j AS (SELECT event_id, scn.industry_code, st.*, mm.* FROM scn LEFT JOIN ka USING (industry_code, event_date) LEFT JOIN st ON st.industry_code = scn.industry_code AND st.d = ka.d LEFT JOIN kb ON kb.event_date = scn.event_date LEFT JOIN mm ON mm.d = kb.d)
 SELECT event_id, industry_code, CASE WHEN k >= 25 AND mk >= 25 THEN r6(i5) END AS ind_r5, CASE WHEN k >= 25 AND mk >= 25 THEN r6(i20 - m20) END AS rel_r20, CASE WHEN k >= 25 AND mk >= 25 THEN r6(vol20) END AS vol20,
   CASE WHEN k >= 25 AND mk >= 25 THEN r6(pos60) END AS pos60, CASE WHEN k >= 25 AND mk >= 25 THEN r6(vtrend) END AS vtrend FROM j""")
def _(s):
    return rounded(X.baseline_features(s.scn, s.px, s.mkt), ["event_id", "industry_code"], ["ind_r5", "rel_r20", "vol20", "pos60", "vtrend"])


PSTATE = f"""b AS (SELECT * {CLEAN}), r AS (SELECT industry_code, d, count(*) OVER f AS n_hist, sum(ret) OVER n AS mom, sum(ret) OVER n - sum(mkt_ret) OVER n AS rel,
   (stddev_pop(ret) OVER n + 1e-8) / (stddev_pop(ret) OVER f + 1e-8) - 1 AS reg, avg(vol_chg) OVER n AS vt FROM b
   WINDOW n AS (PARTITION BY industry_code ORDER BY d ROWS 19 PRECEDING), f AS (PARTITION BY industry_code ORDER BY d ROWS UNBOUNDED PRECEDING)),
 st AS (SELECT *, (exp(2 * z) - 1) / (exp(2 * z) + 1) AS ps FROM (SELECT *, (0.6::DOUBLE * mom + 0.4::DOUBLE * rel) / 0.5 AS z FROM r))"""


@query("c13_state_probe", f"WITH {PSTATE}, " + asof_sql("st", """coalesce(n_hist, 0) AS n_hist, r6(CASE WHEN n_hist >= 20 THEN mom ELSE 0 END) AS momentum, r6(CASE WHEN n_hist >= 20 THEN ps ELSE 0 END) AS pre_state,
  r6(CASE WHEN n_hist >= 20 THEN reg ELSE 0 END) AS vol_regime, r4(CASE WHEN n_hist >= 20 THEN abs(ps) / (1 + greatest(reg, 0)) ELSE 0 END) AS confidence"""))
def _(s):
    return rounded(X.state_probe(s.scn, feat(s), scale=0.5), ["event_id", "industry_code", "n_hist"], ["momentum", "pre_state", "vol_regime"], ["confidence"])


@query("c14_blend_confidence", """WITH st AS (SELECT industry_code, d, least(abs(ret) * 2, 1) AS pc FROM feat WHERE ret IS NOT NULL), k AS (SELECT industry_code, event_date, max(d) AS d FROM probe JOIN st USING (industry_code) WHERE d < event_date GROUP BY 1, 2),
 pr AS (SELECT industry_code, event_date, pc FROM k JOIN st USING (industry_code, d))
 SELECT event_id, industry_code, r6(CASE WHEN pc IS NULL THEN confidence WHEN confidence = 0 THEN pc ELSE least(1, 0.5 * confidence + 0.5 * pc) END) AS confidence FROM res0 LEFT JOIN pr USING (industry_code, event_date)""")
def _(s):
    from evq.functions.windows import asof_join

    st = feat(s).filter("ret is not null").select("industry_code", "d", F.least(F.abs("ret") * 2, F.lit(1.0)).alias("pc"))
    pr = asof_join(s.scn.select("industry_code", "event_date").distinct(), st, ["industry_code"], "event_date", "d", ["pc"], how="inner")
    b = X.blend_confidence(s.res(0), pr, ["industry_code", "event_date"], "confidence", "pc")
    return b.select("event_id", "industry_code", r6("confidence").alias("confidence"))


@query("c15_drift_dampen", """WITH st AS (SELECT industry_code, d, sum(ret) OVER (PARTITION BY industry_code ORDER BY d ROWS 9 PRECEDING) AS pc FROM feat WHERE ret IS NOT NULL),
 k AS (SELECT industry_code, event_date, max(d) AS d FROM probe JOIN st USING (industry_code) WHERE d < event_date GROUP BY 1, 2),
 j AS (SELECT event_id, industry_code, prob_up - 0.5 AS strength, pc, abs(pc) / 0.3 AS ratio FROM res0 LEFT JOIN k USING (industry_code, event_date) LEFT JOIN st USING (industry_code, d))
 SELECT event_id, industry_code, r6(pc) AS pre_cum, r6(strength * CASE WHEN (pc > 0) = (strength > 0) AND ratio > 0.3 THEN 1 - least(ratio * 0.6, 0.6) ELSE 1 END) AS dampened FROM j""")
def _(s):
    p = X.pre_drift(s.res(0).withColumn("strength", F.col("prob_up") - 0.5), feat(s))
    return rounded(X.drift_dampen(p, typical=0.3), ["event_id", "industry_code"], ["pre_cum", "dampened"])


@query("c16_vol_ratio", """WITH b AS (SELECT * FROM feat WHERE ret IS NOT NULL), st AS (SELECT industry_code, d, least(greatest((stddev_pop(ret) OVER (PARTITION BY industry_code ORDER BY d ROWS 9 PRECEDING) + 1e-8)
   / (stddev_pop(ret) OVER (PARTITION BY industry_code ORDER BY d ROWS UNBOUNDED PRECEDING) + 1e-8), 0.5), 4) AS vr FROM b), """ + asof_sql("st", "r6(vr) AS vol_ratio, r6(greatest((vr - 1) * 0.5, 0.15)) AS interval_strength").replace(
           "r6(greatest((vr - 1) * 0.5, 0.15))", "r6(coalesce(greatest((vr - 1) * 0.5, 0.15), 0.15))"))
def _(s):
    return rounded(X.vol_ratio(s.scn, feat(s)), ["event_id", "industry_code"], ["vol_ratio", "interval_strength"])


@query("c17_pivot_returns", "SELECT d, " + ", ".join(f"r6(max(CASE WHEN industry_code = '{c}' THEN r END)) AS {c.lower()}" for c in CODES) + " FROM ret GROUP BY 1")
def _(s):
    return X.pivot_returns(s.px, s.mkt, CODES).select("d", *[r6(c).alias(c.lower()) for c in CODES])


@query("c18_calendar", "SELECT d, CAST(day_idx AS INT) AS day_idx FROM cal")
def _(s):
    return calendar(s.px, s.mkt)


@query("c19_text_strength", "WITH h AS (SELECT doc_id, " + " + ".join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in HIGH) + " AS hits, " + " OR ".join(f"contains(lower(text), '{t}')" for t in NEG)
       + " AS neg FROM docs) SELECT doc_id, hits, r6((CASE WHEN neg THEN -1 ELSE 1 END) * (CASE WHEN hits >= 2 THEN 0.5 WHEN hits = 1 THEN 0.3 ELSE 0.15 END)) AS text_strength FROM h")
def _(s):
    return X.text_strength(s.docs, HIGH, NEG).select("doc_id", "hits", r6("text_strength").alias("text_strength"))
