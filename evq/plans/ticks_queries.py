"""Tick and stream queries (L rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.functions.cols import r6
from evq.operators import ticks as K
from evq.operators.asof import dense_returns
from evq.plans.catalog import query
from evq.streaming import runs

TK = """mc AS (SELECT d, total_fin / lag(total_fin) OVER (ORDER BY d) - 1 AS mc FROM margin), rv AS (SELECT d, industry_code, r, m FROM ret WHERE r IS NOT NULL),
  md AS (SELECT d, max(m) AS m FROM rv GROUP BY 1), tk AS (SELECT coalesce(md.d, mc.d) AS d, m, mc FROM md FULL JOIN mc ON md.d = mc.d),
  fx AS (SELECT d, string_agg(industry_code || ':' || printf('%+.4f', r), ',' ORDER BY industry_code) AS names FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY industry_code) AS k FROM rv WHERE abs(r) >= 0.4) WHERE k <= 5 GROUP BY 1),
  sh AS (SELECT tk.d, m, mc, nullif(concat_ws(' | ', CASE WHEN abs(m) >= 0.1 THEN 'market_move=' || printf('%+.4f', m) END, 'industry_move=' || names, CASE WHEN abs(coalesce(mc, 0)) >= 0.3 THEN 'margin_change=' || printf('%+.4f', mc) END), '') AS tr FROM tk LEFT JOIN fx ON fx.d = tk.d)"""


def rets(s):
    return dense_returns(s.px, s.mkt)


def ticks(s):
    return K.ticks(rets(s), K.margin_change(s.margin))


def shocked(s):
    return K.detect_shocks(ticks(s), 0.1, 0.4, 0.3)


@query("l1_ticks", f"WITH {TK} SELECT tk.d AS date, r6(m) AS market_return, r6(mc) AS margin_change, CAST(coalesce(k, 0) AS INT) AS n_industries, r6(s) AS sum_returns FROM tk LEFT JOIN (SELECT d, count(*) AS k, sum(r) AS s FROM rv GROUP BY 1) q ON q.d = tk.d")
def _(s):
    v = F.aggregate(F.map_values("industry_returns"), F.lit(0.0), lambda a, x: a + x)
    n = F.when(F.col("industry_returns").isNull(), 0).otherwise(F.size("industry_returns"))
    return ticks(s).select("date", r6("market_return").alias("market_return"), r6("margin_change").alias("margin_change"), n.alias("n_industries"), r6(v).alias("sum_returns"))


@query("l2_detect_shocks", f"WITH {TK} SELECT d AS date, tr AS triggered_event FROM sh")
def _(s):
    return shocked(s).select("date", "triggered_event")


@query("l3_leaders", """WITH o AS (SELECT d, industry_code, r, row_number() OVER (PARTITION BY d ORDER BY r DESC, industry_code) AS u, row_number() OVER (PARTITION BY d ORDER BY r, industry_code) AS w FROM ret WHERE r IS NOT NULL)
  SELECT d AS date, industry_code, r6(r) AS r, CAST(u AS INT) AS rank FROM o WHERE u <= 3 UNION ALL SELECT d, industry_code, r6(r), CAST(-w AS INT) FROM o WHERE w <= 3""")
def _(s):
    return K.leaders(rets(s)).select("date", "industry_code", r6("r").alias("r"), "rank")


EDG = f"""{TK}, ed AS (SELECT d AS date, 'market' AS source, 'all_industries' AS target, 0.8::DOUBLE AS weight FROM sh UNION ALL SELECT d, 'capital_flow', 'market', 0.6 FROM sh
  UNION ALL SELECT d, 'event', industry_code, 0.7 FROM (SELECT d, industry_code, row_number() OVER (PARTITION BY d ORDER BY abs(r) DESC, industry_code) AS k FROM rv) WHERE k <= 3 UNION ALL SELECT d, 'triggered_event', 'market', 0.75 FROM sh WHERE tr IS NOT NULL)"""


@query("l4_tick_edges", f"WITH {EDG} SELECT * FROM ed")
def _(s):
    return K.tick_edges(shocked(s)).select("date", "source", "target", "weight")


@query("l5_trace", f"WITH {EDG} SELECT sh.d AS date, r6(m) AS market_return, count(*) AS n_causal_paths, count(DISTINCT source) AS n_sources FROM sh JOIN ed ON ed.date = sh.d GROUP BY 1, 2")
def _(s):
    t = shocked(s)
    return K.trace(t, K.tick_edges(t)).select("date", r6("market_return").alias("market_return"), "n_causal_paths", "n_sources")


HOUR = """SELECT date_trunc('hour', ts) AS w_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS w_end, event_type AS industry_code, count(*) AS n, r6(sum(value)) AS total, r6(avg(value)) AS mean FROM events {w} GROUP BY ALL"""


def shaped(df):
    return df.select("w_start", "w_end", "industry_code", "n", r6("total").alias("total"), r6("mean").alias("mean"))


@query("l6_tumbling_windows", HOUR.format(w=""))
def _(s):
    return shaped(K.tick_windows(s.ticks_src, "tumbling"))


@query("l6_sliding_windows", """WITH e AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS w_start FROM events CROSS JOIN range(2) g(k))
  SELECT w_start, w_start + INTERVAL 1 HOUR AS w_end, event_type AS industry_code, count(*) AS n, r6(sum(value)) AS total, r6(avg(value)) AS mean FROM e GROUP BY ALL""")
def _(s):
    return shaped(K.tick_windows(s.ticks_src, "sliding", "1 hour", "30 minutes"))


@query("l6_session_windows", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS nw FROM events),
  i AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS sid FROM g) SELECT min(ts) AS w_start, max(ts) + INTERVAL 20 MINUTE AS w_end, event_type AS industry_code, count(*) AS n, r6(sum(value)) AS total, r6(avg(value)) AS mean FROM i GROUP BY event_type, sid""")
def _(s):
    return shaped(K.tick_windows(s.ticks_src, "session", "20 minutes"))


@query("l6_stream_windows", "SELECT * FROM (" + HOUR.format(w="") + ") WHERE w_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def _(s):
    raw = runs.file_stream(s.spark, s.dir, s.t("events").schema, "events.parquet")
    src = raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("industry_code"), "value")
    return shaped(runs.run_available(runs.stream_windows(src, "tumbling", "10 minutes")))


def residuals(s):
    return s.fc.filter("step = 0").select("industry_code", "d", (F.col("actual") - F.col("mean")).alias("residual"), F.col("actual").between(F.col("lower_95"), F.col("upper_95")).alias("in_interval"))


@query("l7_residual_monitor", """WITH x AS (SELECT industry_code, d, abs(actual - mean) AS a, CAST(actual BETWEEN lower_95 AND upper_95 AS INT) AS i FROM fc WHERE step = 0),
  y AS (SELECT *, row_number() OVER (PARTITION BY industry_code ORDER BY d) AS k, avg(a) OVER (PARTITION BY industry_code ORDER BY d ROWS 4 PRECEDING) AS ra, avg(i) OVER (PARTITION BY industry_code ORDER BY d ROWS 19 PRECEDING) AS rc FROM x)
  SELECT industry_code, d, r6(CASE WHEN k >= 5 THEN ra END) AS recent_residual, r6(CASE WHEN k >= 20 THEN rc END) AS recent_coverage, CASE WHEN k >= 5 AND ra > 0.25 THEN 'residual' WHEN k >= 20 AND rc < 0.7 THEN 'coverage' END AS reason FROM y""")
def _(s):
    m = K.residual_monitor(residuals(s), ["industry_code"], ["d"], 0.25)
    return m.select("industry_code", "d", r6("recent_residual").alias("recent_residual"), r6("recent_coverage").alias("recent_coverage"), "reason")


@query("l7_residual_monitor_stream", """WITH x AS (SELECT event_id AS seq, event_type AS industry_code, abs(value - 10) AS a, CAST(value BETWEEN 0.5 AND 25 AS INT) AS i FROM events),
  y AS (SELECT *, row_number() OVER (PARTITION BY industry_code ORDER BY seq) AS k, sum(a) OVER (PARTITION BY industry_code ORDER BY seq ROWS 4 PRECEDING) / 5 AS ra, avg(i) OVER (PARTITION BY industry_code ORDER BY seq ROWS 19 PRECEDING) AS rc FROM x)
  SELECT industry_code, seq, CASE WHEN k >= 5 AND ra > 12.003 THEN 'residual' WHEN k >= 20 AND rc < 0.7 THEN 'coverage' END AS reason FROM y""")
def _(s):
    raw = runs.file_stream(s.spark, s.dir, s.t("events").schema, "events.parquet")
    src = raw.select(F.col("event_type").alias("industry_code"), F.col("event_id").alias("seq"), (F.col("value") - 10).alias("residual"), F.col("value").between(0.5, 25).alias("in_interval"))
    return runs.residual_monitor_stream(src, "industry_code", 12.003)


@query("l8_stream_visible", """WITH e AS (SELECT event_id, CAST(ts AS DATE) - 9000 AS d FROM events), c AS (SELECT d, count(*) AS k FROM (SELECT DISTINCT d FROM e) JOIN docs ON coalesce(valid_from, pub_date + 1) <= d GROUP BY 1)
  SELECT event_id, coalesce(k, 0) AS n_visible, (SELECT count(*) FROM docs) - coalesce(k, 0) AS n_hidden FROM e LEFT JOIN c USING (d)""")
def _(s):
    raw = runs.file_stream(s.spark, s.dir, s.t("events").schema, "events.parquet")
    src = raw.select("event_id", F.date_sub(F.to_date("ts"), 9000).alias("ts"))
    return runs.stream_visible(src, s.docs).select("event_id", "n_visible", "n_hidden")


@query("l9_whatif_edges", f"WITH {EDG} SELECT d AS date, 'triggered_event' AS source, 'market' AS target, 0.75::DOUBLE AS weight, 'policy' AS evidence FROM sh WHERE month(d) = 6 AND coalesce(tr, '') <> 'policy'")
def _(s):
    t = shocked(s)
    p = t.filter(F.month("date") == 6).select("date", F.lit(-0.2).alias("market_return"), F.lit("policy").alias("triggered_event"))
    w = K.whatif_edges(t, p)
    return w.select("date", "source", "target", "weight", F.col("evidence_ids")[0].alias("evidence"))
