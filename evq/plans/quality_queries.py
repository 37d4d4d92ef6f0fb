"""Quality-gate queries (M rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.functions.cols import r4, r6
from evq.operators import portfolio as P
from evq.operators import quality as Q
from evq.operators import risk as R
from evq.plans.catalog import query
from evq.plans.graph_queries import CE, causal
from evq.plans.portfolio_queries import VW, wrows
from evq.plans.risk_queries import KUP, PIN
from evq.plans.signals_queries import verdict_resp


def mixed_resp(s):
    """Verdicts of the events and bare chain objects of the order lines."""
    step = F.struct(F.col("l_linestatus").alias("entity"), F.col("l_discount").alias("confidence"))
    chain = F.to_json(F.struct(F.when(F.col("l_quantity") > 5, F.array(step)).otherwise(F.array().cast("array<struct<entity:string,confidence:double>>")).alias("chain")))
    return verdict_resp(s).select("content").unionByName(s.t("lineitem").select(chain.alias("content")))


RESP = """q1 AS (SELECT (SELECT count(*) FROM events) + (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM events WHERE event_type = 'click') AS c, (SELECT count(*) FROM lineitem) AS l, (SELECT count(*) FROM lineitem WHERE l_quantity > 5) AS f),
  m1 AS (SELECT 'responses' AS module, 'json_parse_rate' AS metric, (c + l) / CAST(n AS DOUBLE) AS value FROM q1 UNION ALL SELECT 'responses', 'schema_valid_rate', l / CAST(n AS DOUBLE) FROM q1 UNION ALL SELECT 'responses', 'factor_coverage', f / CAST(n AS DOUBLE) FROM q1)"""
FUS = """q2 AS (SELECT avg(CAST(dir_correct AS INT)) AS a, avg(CASE WHEN NOT abstain THEN CAST(dir_correct AS INT) END) AS c, count(*) FILTER (NOT abstain) AS k, count(*) AS n FROM res0),
  m2 AS (SELECT 'fusion' AS module, 'full_accuracy' AS metric, a AS value FROM q2 UNION ALL SELECT 'fusion', 'selective_accuracy', CASE WHEN k < greatest(5, n * 0.4) THEN 0 ELSE c END FROM q2 UNION ALL SELECT 'fusion', 'coverage', k / CAST(n AS DOUBLE) FROM q2)"""
RSK = f"""q3 AS (SELECT horizon, count(*) AS n, CAST(sum(CAST(realized_car < pred_var AS INT)) AS BIGINT) AS k, {PIN} AS pin FROM rr0 GROUP BY 1),
  m3 AS (SELECT 'risk' AS module, 'kupiec_pass_rate' AS metric, avg(CAST({KUP} <= 3.841458820694124 AS INT)) AS value FROM q3)"""


def shown(df):
    return df.withColumn("value", r4("value"))


@query("m1_response_quality", f"WITH {RESP} SELECT module, metric, r4(value) AS value FROM m1")
def _(s):
    return shown(Q.response_quality(mixed_resp(s)))


@query("m2_fusion_quality", f"WITH {FUS} SELECT module, metric, r4(value) AS value FROM m2")
def _(s):
    return shown(Q.fusion_quality(s.res(0)))


@query("m3_risk_quality", f"WITH {RSK} SELECT module, metric, r4(value) AS value FROM m3")
def _(s):
    return shown(Q.risk_quality(R.backtest_var(s.risk_rows(), ["horizon"])))


def expl(s):
    e = causal(s)
    docs = s.docs.select(F.col("text").alias("narrative"), F.array(F.lit("there"), F.lit("eaux")).alias("industries"), F.when(F.col("lang") == "en", "tion").alias("triggered_event"))
    return Q.explanation_quality(docs, e.select("confidence", "evidence_ids"), e.select("source", "target", "evidence_ids"))


EXP = f"""{CE}, m4 AS (SELECT 'explanation' AS module, 'evidence_coverage' AS metric, avg(n_ev) AS value FROM ce UNION ALL SELECT 'explanation', 'avg_confidence', avg(confidence) FROM ce UNION ALL SELECT 'explanation', 'path_evidence_coverage', avg(n_ev) FROM ce
  UNION ALL SELECT 'explanation', 'industry_mention_rate', avg(CAST(contains(text, 'there') OR contains(text, 'eaux') AS INT)) FROM docs UNION ALL SELECT 'explanation', 'event_mention_rate', avg(CAST(contains(text, 'tion') AS INT)) FROM docs WHERE lang = 'en' UNION ALL SELECT 'explanation', 'cycle_rate', 0.0)"""


@query("m4_explanation_quality", f"WITH {EXP} SELECT module, metric, r4(value) AS value FROM m4")
def _(s):
    return shown(expl(s))


@query("m5_evaluate_gates", f"""WITH {RESP}, {FUS}, {RSK}, {EXP}, a AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3 UNION ALL SELECT * FROM m4),
  t(module, metric, op, threshold) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in Q.THRESHOLDS)}),
  g AS (SELECT module, metric, value, threshold, CASE op WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold ELSE value = threshold END AS passed FROM a JOIN t USING (module, metric))
  SELECT module, metric, r4(value) AS value, threshold, passed, bool_and(passed) OVER (PARTITION BY module) AS module_passed FROM g""")
def _(s):
    m = Q.response_quality(mixed_resp(s)).unionByName(Q.fusion_quality(s.res(0))).unionByName(Q.risk_quality(R.backtest_var(s.risk_rows(), ["horizon"]))).unionByName(expl(s))
    return shown(Q.evaluate_gates(m)).select("module", "metric", "value", "threshold", "passed", "module_passed")


@query("m6_usage", """SELECT role, CAST(turn AS BIGINT) AS turn, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(greatest(length(text) // 4, 1)) AS BIGINT) AS tokens, r6(sum(greatest(length(text) // 4, 1)) * 1e-7 * 1000) AS cost_k FROM conversations GROUP BY 1, 2""")
def _(s):
    u = Q.usage(s.t("conversations").select("role", "turn", F.length("text").alias("chars")), ["role", "turn"])
    return u.select("role", "turn", "calls", "chars", "tokens", r6(F.col("cost") * 1000).alias("cost_k"))


@query("m7_kpi_table", f"""WITH {RSK}, {VW}, s AS (SELECT count(*) AS n, avg(CAST(dir_correct AS INT)) AS f, avg(CASE WHEN NOT abstain THEN CAST(dir_correct AS INT) END) AS c, avg(CAST(NOT abstain AS INT)) AS v FROM res0),
  o AS (SELECT r6(confidence) AS cf, dir_correct, row_number() OVER (ORDER BY r6(confidence) DESC, event_id, event_date, industry_code) AS rn, count(*) OVER () AS n FROM res0),
  c AS (SELECT b, count(*) / CAST(any_value(n) AS DOUBLE) AS cov, avg(CAST(dir_correct AS INT)) AS a, min(cf) AS m FROM o JOIN range(1, 6) g(b) ON rn <= floor(n * b / 10.0) GROUP BY 1),
  p AS (SELECT horizon, sum(realized_car * weight) / sum(weight) AS rc, sum(pred_var * weight) / sum(weight) AS pv, sum(weight * weight) AS hh FROM wv GROUP BY 1)
  SELECT section, item, metric, r4(value) AS value FROM (SELECT 'direction' AS section, 'all' AS item, 'n' AS metric, CAST(n AS DOUBLE) AS value FROM s UNION ALL SELECT 'direction', 'all', 'full_accuracy', f FROM s UNION ALL SELECT 'direction', 'all', 'committed_accuracy', c FROM s UNION ALL SELECT 'direction', 'all', 'coverage', v FROM s
   UNION ALL SELECT 'curve', CAST(b AS VARCHAR), 'coverage', cov FROM c UNION ALL SELECT 'curve', CAST(b AS VARCHAR), 'accuracy', a FROM c UNION ALL SELECT 'curve', CAST(b AS VARCHAR), 'min_confidence', m FROM c
   UNION ALL SELECT 'risk', CAST(horizon AS VARCHAR), 'breach_rate', k / CAST(n AS DOUBLE) FROM q3 UNION ALL SELECT 'risk', CAST(horizon AS VARCHAR), 'pinball_loss', pin FROM q3
   UNION ALL SELECT 'portfolio', CAST(horizon AS VARCHAR), 'realized_car', rc FROM p UNION ALL SELECT 'portfolio', CAST(horizon AS VARCHAR), 'predicted_var', pv FROM p UNION ALL SELECT 'portfolio', CAST(horizon AS VARCHAR), 'hhi', hh FROM p)""")
def _(s):
    rr = s.risk_rows()
    k = Q.kpi_table(s.res(0).withColumn("confidence", r6("confidence")), R.backtest_var(rr, ["horizon"]), P.portfolio_view(wrows(s)))
    return k.filter("metric <> 'kupiec_p'").withColumn("value", r4("value"))
