"""Evaluation queries: ensembles, bootstraps, accuracy tables, forecast metrics (G and H rows)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from evq.functions.cols import r4, r6
from evq.operators import asof as A
from evq.operators import evaluation as V
from evq.operators import metrics as M
from evq.plans.catalog import query
from evq.plans.risk_queries import draw_sql, uniform_sql

EK = ["event_id", "industry_code"]
TYPES = ["1-URGENT"]


def runs(s):
    """Four seeded runs: config base holds seeds 0 and 1, config alt seeds 2 and 3."""
    parts = [s.res(k).withColumns({"seed": F.lit(k), "config": F.lit("base" if k < 2 else "alt"), "run": F.lit(f"r{k}"), "tag": F.lit(format(k, "02b"))}) for k in range(4)]
    return reduce(lambda a, b: a.unionByName(b), parts)


RUNS = "runs AS (" + " UNION ALL ".join(f"SELECT *, {k} AS seed, '{'base' if k < 2 else 'alt'}' AS config, 'r{k}' AS run, '{format(k, '02b')}' AS tag FROM res{k}" for k in range(4)) + ")"
ENS = """ens AS (SELECT *, prob >= 0.5 AS up, (prob >= 0.5) = (real_dir = '+') AS ok, abs(prob - 0.5) * 2 AS conf FROM (SELECT a.event_id, a.event_date, a.industry_code, a.event_type, a.real_dir,
  0.6::DOUBLE * a.prob_up + 0.4::DOUBLE * b.prob_up AS prob FROM res0 a JOIN res1 b USING (event_id, industry_code)))"""


def ens(s):
    return V.ensemble(s.res(0), s.res(1), (0.6, 0.4), 0.1203, TYPES)


@query("g1_ensemble", f"""WITH {ENS} SELECT event_id, industry_code, CASE WHEN up THEN '+' ELSE '-' END AS final_dir, r6(prob) AS prob_up, r6(conf) AS confidence, conf < 0.1203 OR event_type = '1-URGENT' AS abstain,
  ok AS dir_correct, ok AND NOT (conf < 0.1203 OR event_type = '1-URGENT') AS committed_dir_correct FROM ens""")
def _(s):
    return ens(s).select(*EK, "final_dir", r6("prob_up").alias("prob_up"), r6("confidence").alias("confidence"), "abstain", "dir_correct", "committed_dir_correct")


@query("g2_threshold_scan", f"""WITH {ENS}, g AS (SELECT i * 0.025 + 0.0003 AS th FROM range(21) t(i))
  SELECT r4(th) AS threshold, r6(avg(CAST(ok AS INT))) AS full_accuracy, r6(avg(CAST(conf >= th AND event_type <> '1-URGENT' AS INT))) AS coverage,
   r6(avg(CASE WHEN conf >= th AND event_type <> '1-URGENT' THEN CAST(ok AS INT) END)) AS committed_accuracy FROM ens CROSS JOIN g GROUP BY th""")
def _(s):
    t = V.threshold_scan(ens(s), [0.025 * i + 0.0003 for i in range(21)], F.col("event_type").isin(TYPES))
    return t.select(r4("threshold").alias("threshold"), *[r6(c).alias(c) for c in ("full_accuracy", "coverage", "committed_accuracy")])


GRID = ", ".join(f"({i * 5 + k}, {w}::DOUBLE, {t}::DOUBLE)" for i, w in enumerate((0.2, 0.4, 0.5, 0.6, 0.8)) for k, t in enumerate((0.05, 0.10, 0.12, 0.15, 0.20)))


@query("g3_walk_forward_ensemble", f"""WITH j AS (SELECT a.event_id, a.event_date, a.industry_code, a.real_dir, a.prob_up AS pa, b.prob_up AS pb FROM res0 a JOIN res1 b USING (event_id, industry_code)),
  g(o, w, t) AS (VALUES {GRID}),
  d AS (SELECT event_date, o, w, t, count(*) AS n, count(*) FILTER (round(abs(w * pa + (1 - w) * pb - 0.5) * 2, 12) >= t) AS m,
    count(*) FILTER (round(abs(w * pa + (1 - w) * pb - 0.5) * 2, 12) >= t AND (round(w * pa + (1 - w) * pb, 12) >= 0.5) = (real_dir = '+')) AS c FROM j CROSS JOIN g GROUP BY 1, 2, 3, 4),
  u AS (SELECT event_date, o, w, t, sum(n) OVER p AS n, sum(m) OVER p AS m, sum(c) OVER p AS c FROM d WINDOW p AS (PARTITION BY o ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  b AS (SELECT event_date, w, t FROM u WHERE n >= 20 AND m >= 5 QUALIFY row_number() OVER (PARTITION BY event_date ORDER BY round(CAST(c AS DOUBLE) / CAST(m AS DOUBLE) + 0.05::DOUBLE * (CAST(m AS DOUBLE) / CAST(n AS DOUBLE)), 12) DESC, o) = 1)
  SELECT event_id, industry_code, coalesce(w, 0.6) AS weight_a, coalesce(t, 0.12) AS threshold, r6(coalesce(w, 0.6) * pa + (1 - coalesce(w, 0.6)) * pb) AS prob_up,
   round(abs(round(coalesce(w, 0.6::DOUBLE) * pa + (1 - coalesce(w, 0.6::DOUBLE)) * pb, 12) - 0.5) * 2, 12) < coalesce(t, 0.12) AS abstain FROM j LEFT JOIN b USING (event_date)""")
def _(s):
    w = V.walk_forward_ensemble(s.res(0), s.res(1))
    return w.select(*EK, "weight_a", "threshold", r6("prob_up").alias("prob_up"), "abstain")


@query("g4_aggregate_seeds", f"""WITH {RUNS}, g AS (SELECT event_id, industry_code, real_dir, avg(prob_up) AS p, count(*) AS n_seeds, count(DISTINCT prob_up >= 0.5) > 1 AS disagree FROM runs GROUP BY ALL)
  SELECT event_id, industry_code, r6(p) AS prob_up, n_seeds, disagree, disagree OR abs(p - 0.5) * 2 < 0.1203 AS abstain FROM g""")
def _(s):
    g = V.aggregate_seeds(runs(s), n_seeds=4, threshold=0.1203)
    return g.select(*EK, r6("prob_up").alias("prob_up"), "n_seeds", "disagree", "abstain")


@query("g5_majority_vote", f"""WITH {RUNS} SELECT event_id, industry_code, count(*) AS n_runs, CASE WHEN 2 * count(*) FILTER (final_dir = '+') >= count(*) THEN '+' ELSE '-' END AS vote_dir,
  2 * count(*) FILTER (dir_correct) >= count(*) AS vote_correct FROM runs GROUP BY event_id, industry_code""")
def _(s):
    return V.majority_vote(runs(s)).select(*EK, "n_runs", "vote_dir", "vote_correct")


ACC = "avg(CAST(dir_correct AS INT))"


@query("g6_seed_summary", f"""WITH {RUNS}, p AS (SELECT seed, {ACC} AS a, avg(CASE WHEN NOT abstain THEN CAST(dir_correct AS INT) END) AS c, avg(CAST(NOT abstain AS INT)) AS v FROM runs GROUP BY 1)
  SELECT count(*) AS n_seeds, r6(avg(a)) AS full_accuracy_mean, r6(avg(c)) AS committed_accuracy_mean, r6(avg(v)) AS coverage_mean, r6(stddev_pop(a)) AS full_accuracy_std,
   r6(stddev_pop(c)) AS committed_accuracy_std, r6(stddev_pop(v)) AS coverage_std FROM p""")
def _(s):
    g = V.seed_summary(runs(s))
    return g.select("n_seeds", *[r6(c).alias(c) for c in g.columns if c != "n_seeds"])


@query("g7_seed_gap", f"""WITH {RUNS}, p AS (SELECT config, m, coalesce(sd, 0) AS sd FROM (SELECT config, avg(a) AS m, stddev_samp(a) AS sd FROM (SELECT config, seed, {ACC} AS a FROM runs GROUP BY 1, 2) GROUP BY 1))
  SELECT x.config, r6(x.m - b.m) AS delta, r4(abs(x.m - b.m) / sqrt((x.sd * x.sd + b.sd * b.sd) / 2)) AS separation FROM p x JOIN p b ON b.config = 'base' AND x.config <> 'base'""")
def _(s):
    return V.seed_gap(runs(s), "base").select("config", r6("delta").alias("delta"), r4("separation").alias("separation"))


@query("g8_summary", f"""SELECT CASE WHEN grouping(event_type) = 1 AND grouping(industry_code) = 1 THEN 'all' WHEN grouping(event_type) = 0 THEN 'event_type' ELSE 'industry_code' END AS scope,
  coalesce(event_type, industry_code, 'all') AS key, count(*) AS n, r6({ACC}) AS full_accuracy, count(*) FILTER (NOT abstain) AS committed_n, r6(avg(CASE WHEN NOT abstain THEN CAST(dir_correct AS INT) END)) AS committed_accuracy
  FROM res0 GROUP BY GROUPING SETS ((), (event_type), (industry_code))""")
def _(s):
    return V.summary(s.res(0)).select("scope", "key", "n", r6("full_accuracy").alias("full_accuracy"), "committed_n", r6("committed_accuracy").alias("committed_accuracy"))


@query("g9_selective_curve", """WITH o AS (SELECT r6(confidence) AS cf, dir_correct, row_number() OVER (ORDER BY r6(confidence) DESC, event_id, event_date, industry_code) AS rn, count(*) OVER () AS n FROM res0)
  SELECT CAST(b AS INT) AS bin, count(*) AS cumulative_rows, r6(count(*) / CAST(any_value(n) AS DOUBLE)) AS coverage, r6(avg(CAST(dir_correct AS INT))) AS accuracy, r6(min(cf)) AS min_confidence
  FROM o JOIN range(1, 11) g(b) ON rn <= floor(n * b / 10.0) GROUP BY 1""")
def _(s):
    c = V.selective_curve(s.res(0).withColumn("confidence", r6("confidence")))
    return c.select("bin", "cumulative_rows", *[r6(x).alias(x) for x in ("coverage", "accuracy", "min_confidence")])


def binomial_sql(table, source, rest, k, place):
    """`table`(rep, k): how many of `rest` draws (a column of source) hit a value of k among what is left (l), by inverted distribution."""
    return f"""{table}n AS (SELECT DISTINCT {rest} AS m, CAST({k} AS DOUBLE) / l AS p, l FROM {source}),
  {table}t AS (SELECT m, i, sum(CASE WHEN p >= 1 THEN CAST(i = m AS INT) WHEN p <= 0 THEN CAST(i = 0 AS INT) ELSE exp(lgamma(m + 1.0) - lgamma(i + 1.0) - lgamma(m - i + 1.0) + i * ln(p) + (m - i) * ln(1 - p)) END)
    OVER (PARTITION BY m ORDER BY i) AS f FROM (SELECT m, p, unnest(range(0, m + 1)) AS i FROM {table}n)),
  {table} AS (SELECT rep, {rest} AS m, least(count(t.i), any_value({rest})) AS k FROM (SELECT *, {uniform_sql('rep', f"'{place}'")} AS u FROM {source}) s LEFT JOIN {table}t t ON t.m = s.{rest} AND t.f < s.u GROUP BY 1, 2)"""


OUT = """r6(avg(st)) AS boot_mean, r6(quantile_cont(st, 0.025)) AS ci_low, r6(quantile_cont(st, 0.975)) AS ci_high"""


def _paired_sql(where):
    return f"""WITH v AS (SELECT CAST(b.dir_correct AS INT) - CAST(a.dir_correct AS INT) AS v FROM res0 a JOIN res1 b USING (event_id, industry_code) {where}),
    ob AS (SELECT avg(v) AS d, count(*) AS n, count(*) FILTER (v = -1) AS a, count(*) FILTER (v = 0) AS z FROM v),
    s0 AS (SELECT rep, n AS r0, a AS k0, n AS l FROM range(2000) g(rep), ob), {binomial_sql("q0", "s0", "r0", "k0", "0/0")},
    s1 AS (SELECT rep, n - q0.k AS r1, z AS k1, n - a AS l FROM q0, ob), {binomial_sql("q1", "s1", "r1", "k1", "0/1")},
    rp_ AS (SELECT (n - q0.k - q1.k - q0.k) / CAST(n AS DOUBLE) AS st FROM q0 JOIN q1 USING (rep), ob)
    SELECT {OUT}, r6(2 * least(avg(CAST(st <= 0 AS INT)), avg(CAST(st >= 0 AS INT)))) AS p_sign, r6(avg(CAST(abs(st) >= abs(d) AS INT))) AS p_abs, any_value(n) AS n, r6(any_value(d)) AS delta FROM rp_, ob"""


def _paired(s, committed):
    p = V.paired_bootstrap(s.res(0), s.res(1), committed)
    return p.select(*[r6(c).alias(c) for c in ("boot_mean", "ci_low", "ci_high", "p_sign", "p_abs", "delta")], "n")


@query("g10_paired_bootstrap", _paired_sql(""))
def _(s):
    return _paired(s, False)


@query("g11_paired_bootstrap_committed", _paired_sql("WHERE NOT a.abstain AND NOT b.abstain"))
def _(s):
    return _paired(s, True)


def _cluster_sql(val, where="", name=""):
    return f"""SELECT {OUT}, r6(any_value(o)) AS observed, r6(any_value(mac)) AS macro, any_value(nc) AS n_clusters{name} FROM (
    WITH v AS (SELECT *, row_number() OVER (ORDER BY event_date) - 1 AS idx FROM (SELECT event_date, sum({val}) AS s, CAST(count(*) AS DOUBLE) AS k FROM jj {where} GROUP BY 1)),
    dr AS (SELECT rep, {draw_sql(n='(SELECT count(*) FROM v)')} AS idx FROM range(2000) a(rep) CROSS JOIN range((SELECT count(*) FROM v)) b(slot))
    SELECT rep, sum(s) / sum(k) AS st, (SELECT sum(s) / sum(k) FROM v) AS o, (SELECT avg(s / k) FROM v) AS mac, (SELECT count(*) FROM v) AS nc FROM dr JOIN v USING (idx) GROUP BY 1)"""


JJ = "jj AS (SELECT a.event_date, a.real_dir, CAST(a.dir_correct AS INT) AS x, CAST(b.dir_correct AS INT) - CAST(a.dir_correct AS INT) AS dx FROM res0 a JOIN res1 b USING (event_id, industry_code))"
CL = ("boot_mean", "ci_low", "ci_high", "observed", "macro")


@query("g12_cluster_bootstrap", f"WITH {JJ} {_cluster_sql('x')}")
def _(s):
    c = V.cluster_bootstrap(s.res(0), F.col("dir_correct").cast("double"))
    return c.select(*[r6(x).alias(x) for x in CL], "n_clusters")


def _breach_sql(h):
    return f"""SELECT * FROM (WITH ob AS (SELECT count(*) AS n, avg(CAST(realized_car < pred_var AS INT)) AS o, count(*) FILTER (NOT realized_car < pred_var) AS a FROM rr0 WHERE horizon = {h} AND realized_car < pred_var IS NOT NULL),
    s0 AS (SELECT rep, n AS r0, a AS k0, n AS l FROM range(2000) g(rep), ob), {binomial_sql("q0", "s0", "r0", "k0", "0/0")},
    rp_ AS (SELECT (n - k) / CAST(n AS DOUBLE) AS st FROM q0, ob)
    SELECT {h} AS horizon, {OUT}, r6((SELECT o FROM ob)) AS observed FROM rp_)"""


@query("g13_bootstrap_ci", " UNION ALL ".join(_breach_sql(h) for h in (1, 5, 20)))
def _(s):
    rows = s.risk_rows().withColumn("breach", F.col("realized_car") < F.col("pred_var"))
    b = V.bootstrap_ci(rows, "breach", by=["horizon"])
    return b.select("horizon", *[r6(x).alias(x) for x in ("boot_mean", "ci_low", "ci_high", "observed")])


@query("g14_class_accuracy", f"""SELECT event_type, count(*) AS n, r6({ACC}) AS overall, count(*) FILTER (real_dir = '+') AS n_pos, r6(avg(CASE WHEN real_dir = '+' THEN CAST(dir_correct AS INT) END)) AS pos,
  r6(avg(CASE WHEN real_dir = '-' THEN CAST(dir_correct AS INT) END)) AS neg FROM res0 GROUP BY 1""")
def _(s):
    return V.class_accuracy(s.res(0), ["event_type"]).select("event_type", "n", r6("overall").alias("overall"), "n_pos", r6("pos").alias("pos"), r6("neg").alias("neg"))


@query("g15_leakage_bias", f"""WITH {JJ} {_cluster_sql('dx', '', ", 'overall' AS klass")} UNION ALL {_cluster_sql('dx', "WHERE real_dir = '+'", ", 'positive' AS klass")}
  UNION ALL {_cluster_sql('dx', "WHERE real_dir = '-'", ", 'negative' AS klass")}""")
def _(s):
    b = V.leakage_bias(s.res(0), s.res(1))
    return b.select("klass", *[r6(x).alias(x) for x in CL], "n_clusters")


@query("g16_factorial_effects", f"""WITH {RUNS}, c AS (SELECT tag, {ACC} AS a FROM runs GROUP BY 1), b AS (SELECT tag, a, ch, substr(tag, i, 1) = '1' AS o FROM c CROSS JOIN (VALUES (1, 'price'), (2, 'text')) g(i, ch))
  SELECT ch AS channel, r6(avg(CASE WHEN o THEN a END)) AS on_mean, r6(avg(CASE WHEN NOT o THEN a END)) AS off_mean, r6(avg(CASE WHEN o THEN a END) - avg(CASE WHEN NOT o THEN a END)) AS effect FROM b GROUP BY 1""")
def _(s):
    f = V.factorial_effects(runs(s), ["price", "text"])
    return f.select("channel", *[r6(c).alias(c) for c in ("on_mean", "off_mean", "effect")])


@query("g17_noise_band", f"""WITH {RUNS}, p AS (SELECT config, seed, {ACC} AS a FROM runs GROUP BY 1, 2)
  SELECT config, count(*) AS n_runs, r6(avg(a)) AS mean, r6(stddev_samp(a)) AS sd, r6(min(a)) AS lo, r6(max(a)) AS hi FROM p GROUP BY 1""")
def _(s):
    return V.noise_band(runs(s)).select("config", "n_runs", *[r6(c).alias(c) for c in ("mean", "sd", "lo", "hi")])


@query("g18_pairwise_agreement", f"""WITH {RUNS} SELECT a.run AS run_a, b.run AS run_b, count(*) AS n, r6(avg(CAST(a.final_dir = b.final_dir AS INT))) AS agreement, r6(avg(abs(a.prob_up - b.prob_up))) AS mean_gap
  FROM runs a JOIN runs b ON a.event_id = b.event_id AND a.industry_code = b.industry_code AND a.run < b.run GROUP BY 1, 2""")
def _(s):
    p = V.pairwise_agreement(runs(s), error="prob_up")
    return p.select("run_a", "run_b", "n", r6("agreement").alias("agreement"), r6("mean_gap").alias("mean_gap"))


@query("g19_flip_table", f"""WITH {RUNS} SELECT r.run AS config, count(*) AS n, count(*) FILTER (r.dir_correct AND NOT b.dir_correct) AS wrong_to_right, count(*) FILTER (NOT r.dir_correct AND b.dir_correct) AS right_to_wrong,
  count(*) FILTER (r.dir_correct AND NOT b.dir_correct) - count(*) FILTER (NOT r.dir_correct AND b.dir_correct) AS net FROM runs r JOIN res0 b USING (event_id, industry_code) WHERE r.run <> 'r0' GROUP BY 1""")
def _(s):
    r = runs(s).filter("run <> 'r0'").withColumn("config", F.col("run"))
    return V.flip_table(r, s.res(0))


@query("g20_cost_weighted", """SELECT event_type, fp, fn, r6(8 * fp + fn) AS cost, r6((8 * fp + fn) / CAST(n AS DOUBLE)) AS cost_per_row FROM (SELECT event_type, count(*) AS n, count(*) FILTER (final_dir = '+' AND real_dir = '-') AS fp,
  count(*) FILTER (final_dir = '-' AND real_dir = '+') AS fn FROM res0 GROUP BY 1)""")
def _(s):
    return V.cost_weighted(s.res(0), ["event_type"]).select("event_type", "fp", "fn", r6("cost").alias("cost"), r6("cost_per_row").alias("cost_per_row"))


@query("g21_subset_accuracy", f"""SELECT subset, count(*) AS n, r6({ACC}) AS accuracy FROM res0 JOIN (VALUES ('all', ''), ('no_urgent', '1-URGENT'), ('no_low', '5-LOW')) g(subset, dropped) ON event_type <> dropped GROUP BY 1""")
def _(s):
    return V.subset_accuracy(s.res(0), {"all": [], "no_urgent": ["1-URGENT"], "no_low": ["5-LOW"]}).select("subset", "n", r6("accuracy").alias("accuracy"))


@query("g22_ablation_table", f"""WITH {RUNS}, g AS (SELECT config, coalesce(event_type, real_dir, 'all') AS slice, count(*) AS n, {ACC} AS a FROM runs GROUP BY GROUPING SETS ((config), (config, event_type), (config, real_dir)))
  SELECT g.config, g.slice, g.n, r6(g.a) AS accuracy, r6(f.a - g.a) AS drop_vs_full FROM g LEFT JOIN g f ON f.slice = g.slice AND f.config = 'base'""")
def _(s):
    return V.ablation_table(runs(s), "base").select("config", "slice", "n", r6("accuracy").alias("accuracy"), r6("drop_vs_full").alias("drop_vs_full"))


@query("g23_by_year", f"""WITH y AS (SELECT *, year(event_date) AS yr FROM res0), o AS (SELECT avg(CASE WHEN yr > 1999 THEN CAST(dir_correct AS INT) END) - avg(CASE WHEN yr <= 1999 THEN CAST(dir_correct AS INT) END) AS gap FROM y)
  SELECT CAST(yr AS INT) AS year, count(*) AS n, r6({ACC}) AS accuracy, yr > 1999 AS out_of_time, r6(any_value(gap)) AS oot_gap FROM y, o GROUP BY yr""")
def _(s):
    return V.by_year(s.res(0), 1999).select("year", "n", r6("accuracy").alias("accuracy"), "out_of_time", r6("oot_gap").alias("oot_gap"))


@query("h1_forecast_metrics", """SELECT industry_code, count(*) AS n, r6(avg(abs(mean - actual))) AS mae, r6(avg(power(mean - actual, 2))) AS mse, r6(sqrt(avg(power(mean - actual, 2)))) AS rmse, r4(avg(abs((mean - actual) / (abs(actual) + 1e-8)))) AS mape,
  r6(avg(CAST(sign(mean) = sign(actual) AS INT))) AS direction_acc, r6(avg(CAST(actual BETWEEN lower_80 AND upper_80 AS INT))) AS coverage_80, r6(avg(CAST(actual BETWEEN lower_95 AND upper_95 AS INT))) AS coverage_95, r6(avg(upper_95 - lower_95)) AS width_95 FROM fc GROUP BY 1""")
def _(s):
    m = M.forecast_metrics(s.fc, ["industry_code"])
    return m.select("industry_code", "n", *[r6(c).alias(c) for c in ("mae", "mse", "rmse", "direction_acc", "coverage_80", "coverage_95", "width_95")], r4("mape").alias("mape"))


@query("h2_keypoint_direction", """SELECT industry_code, d, CAST(k AS INT) AS k, r6(exp(sum(ln(1 + mean))) - 1) AS pred_cum, r6(exp(sum(ln(1 + actual))) - 1) AS actual_cum,
  (exp(sum(ln(1 + mean))) - 1 >= 0) = (exp(sum(ln(1 + actual))) - 1 >= 0) AS dir_correct FROM fc JOIN (VALUES (1), (3), (5), (10)) g(k) ON step < k GROUP BY 1, 2, 3""")
def _(s):
    return M.keypoint_direction(s.fc, ["industry_code", "d"]).select("industry_code", "d", "k", r6("pred_cum").alias("pred_cum"), r6("actual_cum").alias("actual_cum"), "dir_correct")


@query("h3_chain_quality", """WITH p AS (SELECT conv_id, avg(CASE WHEN role = 'assistant' THEN 0.8 ELSE 0.5 END) AS c, avg(CAST(length(text) > 200 AS INT)) AS e, count(*) AS k FROM conversations GROUP BY 1)
  SELECT count(*) AS n_chains, r6(avg(c)) AS consistency, r6(avg(e)) AS evidence_coverage, r6(avg(k)) AS avg_length FROM p""")
def _(s):
    steps = s.t("conversations").select("conv_id", F.when(F.col("role") == "assistant", 0.8).alias("confidence"), (F.length("text") > 200).cast("int").alias("n_evidence"))
    q = M.chain_quality(steps, "conv_id")
    return q.select("n_chains", *[r6(c).alias(c) for c in ("consistency", "evidence_coverage", "avg_length")])


def _bt_sql(pos, costs, stop=False):
    """Positions per step as SQL text; the stop-loss variant flattens after the first breach."""
    base = f"""p0 AS (SELECT industry_code, d, step, actual AS r, {pos} AS q FROM fc), cg AS (SELECT * FROM (VALUES {', '.join(f'({c}::DOUBLE)' for c in costs)}) g(cost)),
    p1 AS (SELECT p0.*, cost, q * r - abs(q - coalesce(lag(q) OVER w, 0)) * (cost + 0.0005::DOUBLE) AS pnl FROM p0 CROSS JOIN cg WINDOW w AS (PARTITION BY industry_code, d, cost ORDER BY step))"""
    if stop:
        base += """, p2 AS (SELECT *, sum(pnl) OVER (PARTITION BY industry_code, d, cost ORDER BY step) AS cum FROM p1), f AS (SELECT industry_code, d, cost, min(step) AS hit FROM p2 WHERE cum < -0.1 GROUP BY 1, 2, 3),
    p3 AS (SELECT p2.industry_code, p2.d, p2.step, p2.cost, CASE WHEN hit IS NULL OR step <= hit THEN pnl WHEN step = hit + 1 THEN -abs(lag(q) OVER (PARTITION BY p2.industry_code, p2.d, p2.cost ORDER BY step)) * (p2.cost + 0.0005::DOUBLE) ELSE 0 END AS pnl
      FROM p2 LEFT JOIN f USING (industry_code, d, cost))"""
    else:
        base += ", p3 AS (SELECT * FROM p1)"
    return f"""WITH {base}, n0 AS (SELECT *, exp(sum(ln(1 + pnl)) OVER w) AS nav FROM p3 WINDOW w AS (PARTITION BY industry_code, d, cost ORDER BY step)),
    n1 AS (SELECT *, max(nav) OVER (PARTITION BY industry_code, d, cost ORDER BY step) AS peak FROM n0)
    SELECT industry_code, d, cost, r6(arg_max(nav, step) - 1) AS total_return, r4(avg(pnl - 0.02 / 252) / (stddev_pop(pnl) + 1e-8) * sqrt(252)) AS sharpe, r6(max((peak - nav) / (peak + 1e-8))) AS max_drawdown,
     r6(avg(CAST(pnl > 0 AS INT))) AS win_rate FROM n1 GROUP BY 1, 2, 3"""


def _bt(s, **kw):
    b = M.backtest(s.fc, ["industry_code", "d"], **kw)
    return b.select("industry_code", "d", "cost", r6("total_return").alias("total_return"), r4("sharpe").alias("sharpe"), r6("max_drawdown").alias("max_drawdown"), r6("win_rate").alias("win_rate"))


@query("h4_backtest", _bt_sql("sign(mean)", [0.001]))
def _(s):
    return _bt(s)


@query("h5_backtest_stoploss", _bt_sql("sign(mean) * least(1.0::DOUBLE, abs(mean) / 0.05::DOUBLE)", [0.001], True))
def _(s):
    return _bt(s, mode="stoploss", typical=0.05, stop=-0.1)


@query("h6_cost_grid", _bt_sql("sign(mean)", [0.001, 0.002, 0.003]))
def _(s):
    return _bt(s, costs=(0.001, 0.002, 0.003))


@query("h7_rolling_backtest", """WITH n AS (SELECT industry_code, ret, row_number() OVER (PARTITION BY industry_code ORDER BY d) - 1 AS k FROM feat WHERE ret IS NOT NULL),
  w AS (SELECT a.industry_code, a.k, avg(CASE WHEN b.k < a.k + 20 THEN b.ret END) AS f FROM n a JOIN n b ON a.industry_code = b.industry_code AND b.k BETWEEN a.k AND a.k + 24 WHERE a.k % 5 = 0 GROUP BY 1, 2 HAVING count(*) = 25),
  e AS (SELECT w.industry_code, w.k, avg(abs(y.ret - f)) AS ae, avg(power(y.ret - f, 2)) AS se, max(CASE WHEN y.k = w.k + 20 THEN CAST(sign(f) = sign(y.ret) AS INT) END) AS d FROM w JOIN n y ON y.industry_code = w.industry_code AND y.k BETWEEN w.k + 20 AND w.k + 24 GROUP BY 1, 2)
  SELECT industry_code, count(*) AS n_windows, r6(avg(ae)) AS mae, r6(sqrt(avg(se))) AS rmse, r6(avg(d)) AS direction_acc FROM e GROUP BY 1""")
def _(s):
    r = M.rolling_backtest(A.make_windows(s.feat, 20, 5, 5), ["industry_code"])
    return r.select("industry_code", "n_windows", *[r6(c).alias(c) for c in ("mae", "rmse", "direction_acc")])
