"""Model queries (F rows, C10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.functions.cols import r4, r6
from evq.functions.sizing import settled
from evq.operators import asof as A
from evq.operators import features as X
from evq.operators import models as M
from evq.plans.catalog import query
from evq.plans.signals_queries import vectors
from evq.operators.signals import VECTOR, disagreement, raw_score

EK = ["event_id", "industry_code"]
GRID = M.threshold_grid()


def windows(s):
    return A.make_windows(s.feat, 20, 5, 5)


def rows(s):
    return s.res(0).withColumn("disagreement", disagreement(F.col("prob_up") - 0.5, F.col("car")))


@query("c10_text_features", r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM docs),
  g AS (SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, greatest(len(w), 1))])) AS term FROM t),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), v AS (SELECT term, sum(tf) AS ctf, count(*) AS df FROM tf GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 128),
  w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM docs)) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN v USING (term)),
  n AS (SELECT *, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 12) AS weight FROM w)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS INT) AS rank, term, r6(weight) AS weight FROM n QUALIFY rank <= 16""")
def _(s):
    return M.text_features(s.docs, "doc_id").select("doc_id", "rank", "term", r6("weight").alias("weight"))


@query("f1_calibrate_platt")
def _(s):
    d = rows(s).withColumn("label", (F.col("real_dir") == "+").cast("int")).withColumnRenamed("prob_up", "raw")
    score = M.fit_calibrator(d, ["raw", "disagreement"], "label", ["event_date", "event_id", "industry_code"])
    return score(d.select(*EK, "raw", "disagreement")).select(*EK, r6("prob_up").alias("prob_up"))


@query("f2_calibrate_isotonic")
def _(s):
    d = rows(s).select("event_date", *EK, F.col("prob_up").alias("raw"), (F.col("real_dir") == "+").cast("int").alias("label"))
    score = M.fit_calibrator(d, ["raw"], "label", ["event_date", "event_id", "industry_code"], method="isotonic")
    return score(d).select(*EK, r6("prob_up").alias("prob_up"))


@query("f3_walk_forward_score")
def _(s):
    v = vectors(s).drop("prob_up").withColumns({"block": F.year("event_date") * 4 + F.quarter("event_date"), "label": (F.col("real_dir") == "+").cast("int")})
    w = M.walk_forward_score(v, VECTOR, "label", raw_score(), "event_date", "block", ["event_date", "event_id", "industry_code"])
    return w.select(*EK, "block", "n_train", r6("prob_up").alias("prob_up"))


def _sel_sql(good):
    cells = ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(GRID))
    return f"""WITH g(o, t) AS (VALUES {cells}), d AS (SELECT event_type, event_date, o, t, count(*) AS n, count(*) FILTER (round(confidence, 12) >= t) AS m, count(*) FILTER (round(confidence, 12) >= t AND {good}) AS c FROM res0 CROSS JOIN g GROUP BY 1, 2, 3, 4),
    u AS (SELECT event_type, event_date, o, t, coalesce(sum(n) OVER p, 0) AS n, sum(m) OVER p AS m, sum(c) OVER p AS c FROM d WINDOW p AS (PARTITION BY event_type, o ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    al AS (SELECT event_date, coalesce(sum(count(*)) OVER (ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS na FROM res0 GROUP BY 1),
    b AS (SELECT event_type, event_date, t FROM u JOIN al USING (event_date) WHERE na >= 12 AND n >= 8 AND CAST(m AS DOUBLE) / CAST(n AS DOUBLE) >= 0.2
      QUALIFY row_number() OVER (PARTITION BY event_type, event_date ORDER BY round(coalesce(CAST(c AS DOUBLE) / nullif(CAST(m AS DOUBLE), 0), 0) + 0.1::DOUBLE * (CAST(m AS DOUBLE) / CAST(n AS DOUBLE)), 12) DESC, o) = 1)
    SELECT event_id, industry_code, r6(coalesce(t, 0.12)) AS threshold FROM res0 LEFT JOIN b USING (event_type, event_date)"""


@query("f4_selective_threshold", _sel_sql("dir_correct"))
def _(s):
    return M.selective_threshold(s.res(0)).select(*EK, r6("threshold").alias("threshold"))


@query("f4_selective_threshold_label", _sel_sql("real_dir = '+'"))
def _(s):
    return M.selective_threshold(s.res(0), "label").select(*EK, r6("threshold").alias("threshold"))


@query("f5_quantile_policy", "SELECT event_type, count(*) AS n, r6(quantile_cont(prob_up, 0.35)) AS threshold FROM res0 GROUP BY 1 HAVING count(*) >= 5")
def _(s):
    return M.quantile_policy(s.res(0)).select("event_type", "n", r6("threshold").alias("threshold"))


DG = "least(1, greatest(0, abs((exp(2 * (prob_up - 0.5)) - 1) / (exp(2 * (prob_up - 0.5)) + 1) - (exp(10 * car) - 1) / (exp(10 * car) + 1))))"


@query("f6_decide", f"""WITH p AS (SELECT event_type, quantile_cont(prob_up, 0.35) AS t FROM res0 GROUP BY 1), x AS (SELECT r.*, round(confidence, 12) < round(abs(t - 0.5) * 2, 12) AS low, {DG} > 0.55 AS cl, length(industry_code) = 5 AS bare FROM res0 r JOIN p USING (event_type))
  SELECT event_id, industry_code, CASE WHEN low OR cl THEN '0' WHEN prob_up >= 0.5 THEN '+' ELSE '-' END AS final_dir, low OR cl AS abstain,
   concat_ws(';', CASE WHEN low THEN 'low_confidence' END, CASE WHEN cl THEN 'high_disagreement' END, CASE WHEN bare THEN 'no_retrieved_evidence' END) AS abstain_reason FROM x""")
def _(s):
    d = rows(s).withColumns({"n_evidence": F.when(F.length("industry_code") == 5, 0).otherwise(1), "has_factors": F.lit(True)})
    return M.decide(d, M.quantile_policy(s.res(0))).select(*EK, "final_dir", "abstain", "abstain_reason")


WIN = """n AS (SELECT industry_code, d, ret, row_number() OVER (PARTITION BY industry_code ORDER BY d) - 1 AS k FROM feat WHERE ret IS NOT NULL),
  w AS (SELECT a.industry_code, a.d AS start_d, a.k, sum(CASE WHEN b.k < a.k + 20 THEN b.ret END) AS sx, var_pop(CASE WHEN b.k < a.k + 20 THEN b.ret END) + 1e-8 AS vr FROM n a JOIN n b ON a.industry_code = b.industry_code AND b.k BETWEEN a.k AND a.k + 24 WHERE a.k % 5 = 0 GROUP BY 1, 2, 3 HAVING count(*) = 25)"""


@query("f7_forecast_momentum", f"WITH {WIN} SELECT industry_code, start_d, r6(sx / 5) AS signal, r6(vr) AS var, r6(1 / (1 + exp(-3 * sx / 5))) AS prob_up FROM w")
def _(s):
    f = M.forecast_momentum(windows(s))
    return f.select("industry_code", "start_d", r6("signal").alias("signal"), r6("var").alias("var"), r6("prob_up").alias("prob_up"))


def split(s):
    from evq.functions.lineage import cut

    return cut(M.temporal_split(windows(s)))


@query("f8_forecast_ridge")
def _(s):
    w = split(s)
    f = M.forecast_ridge(w.filter("is_train"), w.filter("not is_train"))
    return f.select("industry_code", "start_d", r6("signal").alias("signal"), r6("prob_up").alias("prob_up"))


@query("f9_forecast_gbt")
def _(s):
    w = split(s)
    f = M.forecast_gbt(w.filter("is_train"), w.filter("not is_train"))
    return f.select("industry_code", "start_d", r6("signal").alias("signal"), r6("prob_up").alias("prob_up"))


def candidates(s):
    """Three given forecasts over the same windows: momentum with two look-backs, and no change."""
    w = M.temporal_split(windows(s)).withColumn("is_val", ~F.col("is_train"))
    a = M.forecast_momentum(w, 5, 20).withColumn("model", F.lit("slow"))
    still = a.withColumns({"model": F.lit("still"), "mean": F.array_repeat(F.lit(0.0), 5), "signal": F.lit(0.0), "prob_up": F.lit(0.5)})
    return a.unionByName(M.forecast_momentum(w, 5, 5).withColumn("model", F.lit("fast"))).unionByName(still)


@query("f10_pool_select", """WITH n AS (SELECT industry_code, d, ret, row_number() OVER (PARTITION BY industry_code ORDER BY d) - 1 AS k FROM feat WHERE ret IS NOT NULL),
  w AS (SELECT a.industry_code, a.d AS start_d, a.k, sum(CASE WHEN b.k < a.k + 20 THEN b.ret END) / 5 AS slow, sum(CASE WHEN b.k BETWEEN a.k + 15 AND a.k + 19 THEN b.ret END) / 5 AS fast FROM n a JOIN n b ON a.industry_code = b.industry_code AND b.k BETWEEN a.k AND a.k + 24 WHERE a.k % 5 = 0 GROUP BY 1, 2, 3 HAVING count(*) = 25),
  v AS (SELECT *, row_number() OVER (PARTITION BY industry_code ORDER BY start_d) > greatest(1, floor(count(*) OVER (PARTITION BY industry_code) * 0.8)) AS is_val FROM w),
  l AS (SELECT avg(abs(y.ret - slow)) AS ls, avg(abs(y.ret - fast)) AS lf, avg(abs(y.ret)) AS l0 FROM v JOIN n y ON y.industry_code = v.industry_code AND y.k BETWEEN v.k + 20 AND v.k + 24 WHERE is_val),
  z AS (SELECT 1 / ls / t AS ws, 1 / lf / t AS wf, 1 / l0 / t AS w0, CASE WHEN lf <= ls AND lf <= l0 THEN 'fast' WHEN ls <= l0 THEN 'slow' ELSE 'still' END AS selected FROM (SELECT *, 1 / ls + 1 / lf + 1 / l0 AS t FROM l))
  SELECT industry_code, start_d, r6(ws * slow + wf * fast) AS signal, r6(ws / (1 + exp(-3 * slow)) + wf / (1 + exp(-3 * fast)) + w0 / 2) AS prob_up, selected, 3::BIGINT AS n_models FROM v, z""")
def _(s):
    p = M.pool_select(candidates(s), ["industry_code", "start_d"])
    return p.select("industry_code", "start_d", r6("signal").alias("signal"), r6("prob_up").alias("prob_up"), "selected", "n_models")


@query("f10_pool_models")
def _(s):
    """Momentum, ridge and boosted trees, weighted by their loss on each series' last fifth of windows."""
    p = M.pool_select(M.forecast_pool(split(s)), ["industry_code", "start_d"])
    return p.select("industry_code", "start_d", r6("signal").alias("signal"), r6("prob_up").alias("prob_up"), "selected", "n_models")


CF = """cf AS (SELECT industry_code, least(5, greatest(0.5, quantile_cont(abs(actual - mean) / ((upper_80 - lower_80) / 2 + 1e-8), 0.8))) AS f80, least(5, greatest(0.5, quantile_cont(abs(actual - mean) / ((upper_95 - lower_95) / 2 + 1e-8), 0.95))) AS f95 FROM fc GROUP BY 1)"""


@query("f11_conformal_factors", f"WITH {CF} SELECT industry_code, r6(f80) AS factor_80, r6(f95) AS factor_95 FROM cf")
def _(s):
    return M.conformal_factors(s.fc, ["industry_code"]).select("industry_code", r6("factor_80").alias("factor_80"), r6("factor_95").alias("factor_95"))


@query("f12_rescale_interval", f"""WITH {CF} SELECT industry_code, d, step, r6((lower_80 + upper_80) / 2 - (upper_80 - lower_80) / 2 * f80 * 1.25 * 1.2) AS lower_80, r6((lower_95 + upper_95) / 2 + (upper_95 - lower_95) / 2 * f95 * 1.25 * 1.2) AS upper_95
  FROM fc JOIN cf USING (industry_code)""")
def _(s):
    r = M.rescale_interval(s.fc, M.conformal_factors(s.fc, ["industry_code"]), ["industry_code"], F.lit(0.4))
    return r.select("industry_code", "d", "step", r6("lower_80").alias("lower_80"), r6("upper_95").alias("upper_95"))


@query("f13_align_sign", """SELECT event_id, industry_code, r6(CASE WHEN confidence >= 0.2003 AND abs(car) <= 0.12 AND (car >= 0) <> (prob_up >= 0.5) THEN (CASE WHEN prob_up >= 0.5 THEN 1 ELSE -1 END) * greatest(abs(car), 0.12 * (0.5 + 0.5 * (abs(least(0.9999, greatest(0.0001, prob_up)) - 0.5) * 2))) ELSE car END) AS aligned FROM res0""")
def _(s):
    return s.res(0).select(*EK, r6(M.align_sign(F.col("car"), F.col("prob_up"), min_conf=0.2003)).alias("aligned"))


PST = """pa AS (SELECT event_date, coalesce(sum(count(*)) OVER w, 0) AS n, coalesce(sum(count(*) FILTER (real_dir = '+')) OVER w, 0) AS u FROM res0 GROUP BY 1 WINDOW w AS (ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  gl AS (SELECT avg(CAST(real_dir = '+' AS INT)) >= 0.5 AS g FROM res0),
  b1 AS (SELECT r.*, CASE WHEN CASE WHEN n = 0 THEN g ELSE 2 * u >= n END THEN '+' ELSE '-' END AS b1 FROM res0 r JOIN pa USING (event_date), gl)"""


@query("f14_baseline_majority", f"WITH {PST} SELECT event_id, industry_code, b1 FROM b1")
def _(s):
    return M.baseline_majority(s.res(0)).select(*EK, "b1")


@query("f15_baseline_type_prior", f"""WITH {PST}, pt AS (SELECT event_type, event_date, coalesce(sum(count(*)) OVER w, 0) AS tn, coalesce(sum(count(*) FILTER (real_dir = '+')) OVER w, 0) AS tu FROM res0 GROUP BY 1, 2 WINDOW w AS (PARTITION BY event_type ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT event_id, industry_code, CASE WHEN tn >= 3 THEN CASE WHEN 2 * tu >= tn THEN '+' ELSE '-' END ELSE b1 END AS b2 FROM b1 JOIN pt USING (event_type, event_date)""")
def _(s):
    return M.baseline_type_prior(s.res(0)).select(*EK, "b2")


@query("f16_baseline_momentum", """WITH i AS (SELECT industry_code, d, row_number() OVER o AS k, coalesce(close / lag(close, 20) OVER o - 1, 0) AS i20 FROM px WINDOW o AS (PARTITION BY industry_code ORDER BY d)),
  m AS (SELECT d, row_number() OVER (ORDER BY d) AS mk, coalesce(mkt_close / lag(mkt_close, 20) OVER (ORDER BY d) - 1, 0) AS m20 FROM mkt),
  ka AS (SELECT industry_code, event_date, max(d) AS d FROM probe JOIN i USING (industry_code) WHERE d < event_date GROUP BY 1, 2)
  SELECT event_id, scn.industry_code, CASE WHEN coalesce(CASE WHEN k >= 25 AND mk >= 25 THEN i20 - m20 END, 0) >= 0 THEN '+' ELSE '-' END AS b3 FROM scn LEFT JOIN ka USING (industry_code, event_date)
  LEFT JOIN i ON i.industry_code = scn.industry_code AND i.d = ka.d LEFT JOIN m ON m.d = ka.d""")
def _(s):
    return M.baseline_momentum(X.baseline_features(s.scn, s.px, s.mkt)).select(*EK, "b3")


def ml_rows(s):
    """Features hang on industry and date alone, so predictions look them up and are not shuffled."""
    dates = s.scn.select("industry_code", "event_date").distinct()
    b = settled(X.baseline_features(dates, s.px, s.mkt).select("industry_code", F.col("event_date").alias("_on"), *X.BASELINE))
    res = s.res(0)
    return s.dated(res).join(b, ["industry_code", "_on"], "left").select(*EK, *[c for c in res.columns if c not in EK], *X.BASELINE)


@query("f17_baseline_logistic")
def _(s):
    return M.baseline_ml(ml_rows(s), X.BASELINE, "logistic", order=EK, max_train=1_000).select(*EK, "pred")


@query("f17_baseline_gbt")
def _(s):
    return M.baseline_ml(ml_rows(s), X.BASELINE, "gbt", order=EK).select(*EK, "pred")


@query("f18_baseline_text")
def _(s):
    d = s.docs.join(s.t("labels").select("doc_id", F.when(F.col("quality") == 1, "+").otherwise("-").alias("real_dir")), "doc_id").filter("pub_date is not null")
    d = d.select("doc_id", "text", "real_dir", F.col("pub_date").alias("event_date"))
    return M.baseline_text(d).select("doc_id", "real_dir", "pred")
