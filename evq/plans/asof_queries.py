"""Temporal-firewall queries (B rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.functions.cols import r4, r6
from evq.operators import asof as A
from evq.operators.features import features
from evq.plans.catalog import query

FC = A.FEATURE_COLS
VIS = "coalesce(valid_from, pub_date + 1)"
CLEAN = "FROM feat WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FC)


def feat(s):
    return s.feat


@query("b1_pre_event", """SELECT event_id, industry_code, coalesce(n_rows, 0) AS n_rows, first_d, last_d, r4(total) AS total FROM scn LEFT JOIN
  (SELECT industry_code, event_date, count(*) AS n_rows, min(d) AS first_d, max(d) AS last_d, sum(close) AS total FROM probe JOIN px USING (industry_code)
   WHERE d < event_date GROUP BY 1, 2) USING (industry_code, event_date)""")
def _(s):
    return A.pre_event(s.scn, s.px).select("event_id", "industry_code", "n_rows", "first_d", "last_d", r4("total").alias("total"))


@query("b2_visible", f"""SELECT doc_id, coalesce({VIS} <= DATE '1999-06-30', false) AS strict_vis,
  coalesce(coalesce(valid_from, pub_date) <= DATE '1999-06-30', false) AS incl_vis FROM docs""")
def _(s):
    t = F.lit("1999-06-30").cast("date")
    return s.docs.select("doc_id", A.visible(t).alias("strict_vis"), A.visible(t, "inclusive").alias("incl_vis"))


@query("b3_leaks", f"""WITH pk AS (SELECT c.conv_id AS query_id, d.doc_id, DATE '1996-01-01' + CAST(turn * 200 AS INT) AS as_of
    FROM conversations c JOIN docs d ON d.doc_id = c.conv_id)
  SELECT query_id, doc_id, as_of FROM pk JOIN docs USING (doc_id) WHERE NOT coalesce({VIS} <= as_of, false)""")
def _(s):
    pk = s.t("conversations").select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("doc_id"),
                                     F.expr("date_add(DATE '1996-01-01', CAST(turn * 200 AS INT))").alias("as_of"))
    return A.leaks(pk.join(s.docs.select("doc_id"), "doc_id", "left_semi"), s.docs).select("query_id", "doc_id", "as_of")


@query("b4_visibility_counts", f"""WITH e AS (SELECT DISTINCT event_date FROM ev), c AS (SELECT event_date, count(*) AS k FROM e JOIN docs ON {VIS} <= event_date GROUP BY 1)
  SELECT event_id, event_date, coalesce(k, 0) AS n_visible, (SELECT count(*) FROM docs) - coalesce(k, 0) AS n_hidden FROM ev LEFT JOIN c USING (event_date)""")
def _(s):
    return A.visibility_counts(s.ev, s.docs).select("event_id", "event_date", "n_visible", "n_hidden")


@query("b5_n_past_events", """WITH p AS (SELECT event_date, CAST(coalesce(sum(count(*)) OVER (ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_past FROM ev GROUP BY 1)
  SELECT event_id, event_date, n_past FROM ev JOIN p USING (event_date)""")
def _(s):
    return A.n_past_events(s.ev).select("event_id", "event_date", "n_past")


@query("b6_anchor", "SELECT event_id, event_date, t0, CAST(t0_idx AS INT) AS t0_idx FROM ev LEFT JOIN anch USING (event_date)")
def _(s):
    return A.anchor(s.ev, A.calendar(s.px, s.mkt)).select("event_id", "event_date", "t0", "t0_idx")


NUM = f"""num AS (SELECT *, row_number() OVER (PARTITION BY industry_code ORDER BY d) - 1 AS idx, count(*) OVER (PARTITION BY industry_code) AS n {CLEAN}),
  st AS (SELECT industry_code, event_date, t0, i AS idx, n, CASE WHEN i IS NULL THEN 'no_rows_after' WHEN i < 30 THEN 'short_before' WHEN i + 10 > n THEN 'short_after' ELSE 'ok' END AS status
   FROM probe LEFT JOIN (SELECT industry_code, event_date, min(d) AS t0, min(idx) AS i, any_value(n) AS n FROM probe JOIN num USING (industry_code) WHERE d >= event_date GROUP BY 1, 2) USING (industry_code, event_date))"""


@query("b7_event_window_status", f"""WITH {NUM} SELECT event_id, industry_code, t0, status FROM scn JOIN st USING (industry_code, event_date)""")
def _(s):
    return A.event_window(feat(s), s.scn, 30, 10)[0].select("event_id", "industry_code", "t0", "status")


@query("b7_event_window_rows", f"""WITH {NUM}, a AS (SELECT DISTINCT industry_code, t0, idx FROM st WHERE status = 'ok')
  SELECT industry_code, a.t0, CAST(num.idx - a.idx AS INT) AS off, num.d, r6(ret) AS ret, r6(ma20_gap) AS ma20_gap FROM a JOIN num USING (industry_code)
  WHERE num.idx BETWEEN a.idx - 30 AND a.idx + 9""")
def _(s):
    return A.event_window(feat(s), s.scn, 30, 10)[1].select("industry_code", "t0", "off", "d", r6("ret").alias("ret"), r6("ma20_gap").alias("ma20_gap"))


@query("b8_window_zscore", f"""WITH {NUM}, a AS (SELECT DISTINCT industry_code, t0, idx FROM st WHERE status = 'ok'),
  w AS (SELECT industry_code, a.t0, CAST(num.idx - a.idx AS INT) AS off, ret, vol_chg, volatility FROM a JOIN num USING (industry_code) WHERE num.idx BETWEEN a.idx - 30 AND a.idx + 9),
  z AS (SELECT industry_code, t0, avg(ret) AS m1, stddev_pop(ret) AS s1, avg(volatility) AS m2, stddev_pop(volatility) AS s2 FROM w WHERE off < 0 GROUP BY 1, 2)
  SELECT industry_code, t0, off, r4((ret - m1) / (s1 + 1e-8)) AS ret, r4((volatility - m2) / (s2 + 1e-8)) AS volatility FROM w JOIN z USING (industry_code, t0)""")
def _(s):
    z = A.window_zscore(A.event_window(feat(s), s.scn, 30, 10)[1])
    return z.select("industry_code", "t0", "off", r4("ret").alias("ret"), r4("volatility").alias("volatility"))


@query("b9_history_zscore", f"""WITH num AS (SELECT *, row_number() OVER (PARTITION BY industry_code ORDER BY d) AS k {CLEAN}),
  h AS (SELECT industry_code, event_date, max(k) AS n_hist FROM probe JOIN num USING (industry_code) WHERE d < event_date GROUP BY 1, 2),
  c AS (SELECT DISTINCT industry_code, CAST(floor(n_hist * 0.8) AS INT) AS n_fit FROM h),
  m AS (SELECT industry_code, n_fit, avg(ret) AS rm, stddev_pop(ret) + 1e-8 AS rs, avg(vol_chg) AS vm FROM c JOIN num USING (industry_code) WHERE k <= n_fit GROUP BY 1, 2)
  SELECT event_id, industry_code, CAST(n_hist AS INT) AS n_hist, CAST(floor(n_hist * 0.8) AS INT) AS n_fit, r6(rm) AS ret_mean, r6(rs) AS ret_std, r6(vm) AS vol_chg_mean
  FROM scn LEFT JOIN h USING (industry_code, event_date) LEFT JOIN m ON m.industry_code = scn.industry_code AND m.n_fit = CAST(floor(n_hist * 0.8) AS INT)""")
def _(s):
    return A.history_zscore_stats(feat(s), s.scn).select("event_id", "industry_code", "n_hist", "n_fit", r6("ret_mean").alias("ret_mean"),
                                                         r6("ret_std").alias("ret_std"), r6("vol_chg_mean").alias("vol_chg_mean"))


@query("b10_pre_event_matrix", f"""WITH f AS (SELECT * {CLEAN}), x AS (SELECT industry_code, event_date, d, ret, mkt_ret, ma5_gap FROM probe JOIN f USING (industry_code)
    WHERE d < event_date QUALIFY row_number() OVER (PARTITION BY industry_code, event_date ORDER BY d DESC) <= 8)
  SELECT industry_code, event_date, CAST(row_number() OVER (PARTITION BY industry_code, event_date ORDER BY d) - 1 AS INT) AS pos, d, r6(ret) AS ret, r6(mkt_ret) AS mkt_ret, r6(ma5_gap) AS ma5_gap FROM x""")
def _(s):
    m = A.pre_event_matrix(feat(s), s.scn, 8)
    return m.select("industry_code", "event_date", "pos", "d", *[r6(c).alias(c) for c in ("ret", "mkt_ret", "ma5_gap")])


@query("b11_make_windows", """WITH n AS (SELECT industry_code, d, ret, row_number() OVER (PARTITION BY industry_code ORDER BY d) - 1 AS k FROM feat WHERE ret IS NOT NULL),
  w AS (SELECT a.industry_code, a.d AS start_d, a.k AS start, sum(CASE WHEN b.k < a.k + 20 THEN b.ret END) AS sx, sum(CASE WHEN b.k >= a.k + 20 THEN b.ret END) AS sy, count(*) AS c
    FROM n a JOIN n b ON a.industry_code = b.industry_code AND b.k BETWEEN a.k AND a.k + 24 WHERE a.k % 5 = 0 GROUP BY 1, 2, 3)
  SELECT industry_code, start_d, CAST(start AS INT) AS start, r6(sx) AS sum_x, r6(sy) AS sum_y FROM w WHERE c = 25""")
def _(s):
    w = A.make_windows(feat(s), 20, 5, step=5)

    def tot(c):
        return r6(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    return w.select("industry_code", "start_d", "start", tot("x").alias("sum_x"), tot("y").alias("sum_y"))
