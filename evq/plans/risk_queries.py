"""Risk queries: VaR and ES, event risk, back-tests (I1-I15, I30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.functions.cols import r4, r6
from evq.operators import risk as R
from evq.operators.asof import dense_returns
from evq.operators.portfolio import vol_var
from evq.plans.catalog import query

ORDER = ["event_date", "event_id", "industry_code"]


def rets(s):
    return dense_returns(s.px, s.mkt)


def _ve(s, method):
    v = R.var_es(rets(s), ["industry_code"], method, 0.05)
    return v.select("industry_code", r6("var").alias("var"), r6("es").alias("es"))


HIST = """h AS (SELECT industry_code, quantile_cont(r, {a}) AS v FROM ret WHERE r IS NOT NULL GROUP BY 1),
  hist AS (SELECT industry_code, v, avg(r) AS e FROM ret JOIN h USING (industry_code) WHERE r <= v GROUP BY 1, 2)"""
PDF5 = "exp(-power(1.6448536269514722, 2) / 2) / (0.05 * sqrt(2 * pi()))"
EVT = """t AS (SELECT industry_code, quantile_cont(-r, 0.9) AS thr, count(*) AS n FROM ret WHERE r IS NOT NULL GROUP BY 1),
  x AS (SELECT industry_code, thr, n, count(*) AS k, avg(-r - thr) AS m, var_samp(-r - thr) AS v FROM ret JOIN t USING (industry_code) WHERE -r > thr GROUP BY 1, 2, 3),
  g AS (SELECT *, 0.5 * (m * m / v - 1) AS sh, 0.5 * m * (m * m / v + 1) AS sc, n / CAST(k AS DOUBLE) * 0.05 AS tp FROM x),
  w AS (SELECT *, thr + sc / sh * (power(tp, -sh) - 1) AS lv FROM g)"""


@query("i1_var_es_historical", f"WITH {HIST.format(a=0.05)} SELECT industry_code, r6(v) AS var, r6(e) AS es FROM hist")
def _(s):
    return _ve(s, "historical")


def uniform_sql(rep="rep", place="slot"):
    """Leading 52 bits of the MD5 of replicate and place, as a number in [0, 1)."""
    return f"(('0x' || substr(md5({rep} || ':' || {place}), 1, 13))::UBIGINT / 4503599627370496.0)"


def draw_sql(rep="rep", slot="slot", n="n"):
    """Resample index as SQL text."""
    return f"CAST(floor({uniform_sql(rep, slot)} * {n}) AS BIGINT)"


# Counts of ascending distinct values, each binomial given those before it, until the order statistics are passed.
@query("i2_var_es_bootstrap", f"""WITH RECURSIVE v AS (SELECT industry_code, round(r, 12) AS x, count(*) AS k FROM ret WHERE r IS NOT NULL GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY industry_code ORDER BY x) - 1 AS i, CAST(sum(k) OVER (PARTITION BY industry_code) AS BIGINT) AS n, CAST(sum(k) OVER (PARTITION BY industry_code ORDER BY x DESC) AS BIGINT) AS l FROM v),
  z AS (SELECT *, (n - 1) * CAST(0.05 AS DOUBLE) AS h, least(CAST(floor((n - 1) * CAST(0.05 AS DOUBLE)) AS BIGINT) + 1, n - 1) AS hi FROM o),
  near AS (SELECT *, CAST(k AS DOUBLE) / l AS p FROM z WHERE n - l <= 2 * hi + 100),
  g AS (SELECT industry_code, i, p, k, m, unnest(range(0, least(m, 60 + 2 * k) + 1)) AS j FROM (SELECT *, unnest(range(n - hi, n + 1)) AS m FROM near)),
  t AS (SELECT industry_code, i, m, j, sum(CASE WHEN p >= 1 THEN CAST(j = m AS INT) ELSE exp(lgamma(m + 1.0) - lgamma(j + 1.0) - lgamma(m - j + 1.0) + j * ln(p) + (m - j) * ln(1 - p)) END)
    OVER (PARTITION BY industry_code, i, m ORDER BY j) AS f FROM g),
  c AS (SELECT industry_code, i, m, list(f ORDER BY j) AS fs FROM t GROUP BY 1, 2, 3),
  u AS (SELECT i, rep, {uniform_sql("rep", "'0/' || i")} AS u FROM (SELECT DISTINCT i FROM near), range(1000) q(rep)),
  w AS (SELECT industry_code, rep, CAST(-1 AS BIGINT) AS i, CAST(any_value(n) AS BIGINT) AS m, CAST(0 AS BIGINT) AS d FROM o, range(1000) q(rep) GROUP BY 1, 2
    UNION ALL SELECT w.industry_code, w.rep, z.i, w.m - len(list_filter(c.fs, lambda f: f < u.u)), len(list_filter(c.fs, lambda f: f < u.u))
      FROM w JOIN z ON z.industry_code = w.industry_code AND z.i = w.i + 1 AND w.m >= z.n - z.hi JOIN c ON c.industry_code = z.industry_code AND c.i = z.i AND c.m = w.m JOIN u ON u.i = z.i AND u.rep = w.rep),
  s AS (SELECT w.industry_code, w.rep, x, d, n - w.m AS upto, h, floor(h) AS lo, hi FROM w JOIN z USING (industry_code, i)),
  a AS (SELECT industry_code, rep, any_value(h) - any_value(lo) AS f, min(x) FILTER (WHERE upto > lo) AS xa, min(x) FILTER (WHERE upto > hi) AS xb,
    sum(d * x) FILTER (WHERE upto - d <= lo) / sum(d) FILTER (WHERE upto - d <= lo) AS e FROM s GROUP BY 1, 2)
  SELECT industry_code, r6(avg(xa + f * (xb - xa))) AS var, r6(avg(e)) AS es FROM a GROUP BY 1""")
def _(s):
    v = R.var_es(rets(s).withColumn("r", F.round("r", 12)), ["industry_code"], "bootstrap", 0.05)
    return v.select("industry_code", r6("var").alias("var"), r6("es").alias("es"))


@query("i3_var_es_parametric", f"SELECT industry_code, r6(avg(r) - 1.6448536269514722 * stddev_samp(r)) AS var, r6(avg(r) - stddev_samp(r) * {PDF5}) AS es FROM ret WHERE r IS NOT NULL GROUP BY 1")
def _(s):
    return _ve(s, "parametric")


EWMA = """a AS (SELECT industry_code, r, avg(r) OVER (PARTITION BY industry_code) AS mu, row_number() OVER (PARTITION BY industry_code ORDER BY d DESC) - 1 AS k FROM ret WHERE r IS NOT NULL),
  ew AS (SELECT industry_code, any_value(mu) AS mu, sqrt(sum(power(r - mu, 2) * power(0.94, k)) / sum(power(0.94, k))) AS sg FROM a GROUP BY 1)"""


@query("i4_var_es_ewma", f"WITH {EWMA} SELECT industry_code, r6(mu - 1.6448536269514722 * sg) AS var, r6(mu - sg * {PDF5}) AS es FROM ew")
def _(s):
    return _ve(s, "ewma")


@query("i5_var_es_evt", f"WITH {EVT} SELECT industry_code, r6(-lv) AS var, r6(-(lv + sc - sh * thr) / (1 - sh)) AS es FROM w")
def _(s):
    return _ve(s, "evt")


@query("i6_risk_grid", f"""WITH {HIST.format(a=0.05)}, {EWMA}, p AS (SELECT industry_code, avg(r) AS mu, stddev_samp(r) AS sg FROM ret WHERE r IS NOT NULL GROUP BY 1),
  {HIST.format(a=0.01).replace('h AS (', 'h1 AS (', 1).replace('hist AS (', 'hist1 AS (').replace('JOIN h USING', 'JOIN h1 USING')},
  u AS (SELECT industry_code, 0.05 AS alpha, 'historical' AS method, v, e FROM hist UNION ALL SELECT industry_code, 0.01, 'historical', v, e FROM hist1
    UNION ALL SELECT industry_code, 0.05, 'parametric', mu - 1.6448536269514722 * sg, mu - sg * {PDF5} FROM p
    UNION ALL SELECT industry_code, 0.01, 'parametric', mu - 2.3263478740408408 * sg, mu - sg * exp(-power(2.3263478740408408, 2) / 2) / (0.01 * sqrt(2 * pi())) FROM p
    UNION ALL SELECT industry_code, 0.05, 'ewma', mu - 1.6448536269514722 * sg, mu - sg * {PDF5} FROM ew
    UNION ALL SELECT industry_code, 0.01, 'ewma', mu - 2.3263478740408408 * sg, mu - sg * exp(-power(2.3263478740408408, 2) / 2) / (0.01 * sqrt(2 * pi())) FROM ew)
  SELECT industry_code, CAST(alpha AS DOUBLE) AS alpha, method, CAST(horizon AS INT) AS horizon, r6(v * sqrt(horizon)) AS var, r6(e * sqrt(horizon)) AS es FROM u CROSS JOIN (VALUES (1), (5), (20)) g(horizon)""")
def _(s):
    g = R.risk_grid(rets(s), ["industry_code"], methods=("historical", "parametric", "ewma"))
    return g.select("industry_code", "alpha", "method", "horizon", r6("var").alias("var"), r6("es").alias("es"))


FORM = """SELECT industry_code, d, sum(mean) AS mu, sqrt(sum(power(abs(upper_95 - lower_95) / 3.92 * 1.25, 2))) AS sd FROM fc WHERE step < 5 GROUP BY 1, 2"""


@query("i7_event_risk", f"""SELECT industry_code, d, r6(mu - 1.6448536269514722 * sd) AS event_var, r6(mu - sd * {PDF5}) AS cvar, r6(mu - 1.9599639845400545 * sd) AS risk_lo, r6(mu + 1.9599639845400545 * sd) AS risk_hi,
  true AS mdd_in_range FROM ({FORM})""")
def _(s):
    e = R.event_risk(s.fc, ["industry_code", "d"], 5, dispersion=F.lit(0.25))
    return e.select("industry_code", "d", *[r6(c).alias(c) for c in ("event_var", "cvar", "risk_lo", "risk_hi")],
                    F.col("expected_mdd").between(0, 1).alias("mdd_in_range"))


@query("i7_event_risk_simulated")
def _(s):
    return R.event_risk(s.fc, ["industry_code", "d"], 5, dispersion=F.lit(0.25)).select(
        "industry_code", "d", r6("expected_mdd").alias("expected_mdd"), r6("prob_breach").alias("prob_breach"), r6("tail_prob").alias("tail_prob"))


@query("i8_event_risk_legacy", """WITH c AS (SELECT *, 1 + sum(mean) OVER (PARTITION BY industry_code, d ORDER BY step) AS nav FROM fc WHERE step < 5),
  p AS (SELECT *, greatest(1.0, max(nav) OVER (PARTITION BY industry_code, d ORDER BY step)) AS peak FROM c)
  SELECT industry_code, d, r6(sum(lower_95)) AS event_var, r6(least(1, greatest(0, max((peak - nav) / (peak + 1e-8))))) AS expected_mdd, r6(0.05 * 1.25) AS tail_prob,
    r6(sum(lower_95)) AS risk_lo, r6(sum(upper_95)) AS risk_hi FROM p GROUP BY 1, 2""")
def _(s):
    e = R.event_risk(s.fc, ["industry_code", "d"], 5, dispersion=F.lit(0.25), method="legacy")
    return e.select("industry_code", "d", *[r6(c).alias(c) for c in ("event_var", "expected_mdd", "tail_prob", "risk_lo", "risk_hi")])


@query("i9_max_drawdown", """WITH c AS (SELECT *, 1 + sum(actual) OVER (PARTITION BY industry_code, d ORDER BY step) AS nav FROM fc),
  p AS (SELECT *, greatest(1.0, max(nav) OVER (PARTITION BY industry_code, d ORDER BY step)) AS peak FROM c)
  SELECT industry_code, d, r6(least(1, greatest(0, max((peak - nav) / peak)))) AS mdd FROM p GROUP BY 1, 2""")
def _(s):
    arr = R.path_arrays(s.fc.withColumn("mean", F.col("actual")), ["industry_code", "d"], 10)
    from evq.functions.series import running

    return arr.select("industry_code", "d", r6(R.max_drawdown(running(F.col("_p")))).alias("mdd"))


KUP = """-2 * ((n - k) * ln(0.95) + k * ln(0.05) - ((n - k) * ln(greatest(1e-12, least(1 - 1e-12, 1 - k / CAST(n AS DOUBLE)))) + k * ln(greatest(1e-12, least(1 - 1e-12, k / CAST(n AS DOUBLE))))))"""


@query("i10_kupiec", f"SELECT horizon, n, k AS n_breach, r4({KUP}) AS kupiec_lr FROM (SELECT CAST(horizon AS INT) AS horizon, count(*) AS n, CAST(sum(CAST(realized_car < pred_var AS INT)) AS BIGINT) AS k FROM rr0 GROUP BY 1)")
def _(s):
    k = R.kupiec(s.risk_rows(), ["horizon"])
    return k.select("horizon", "n", "n_breach", r4("kupiec_lr").alias("kupiec_lr"))


CHR = """c AS (SELECT {by}, CAST(realized_car < pred_var AS INT) AS b, lag(CAST(realized_car < pred_var AS INT)) OVER (PARTITION BY {by} ORDER BY event_date, event_id, industry_code) AS pb FROM {src}),
  t AS (SELECT {by}, CAST(count(*) FILTER (pb = 0 AND b = 0) AS BIGINT) AS n00, CAST(count(*) FILTER (pb = 0 AND b = 1) AS BIGINT) AS n01, CAST(count(*) FILTER (pb = 1 AND b = 0) AS BIGINT) AS n10, CAST(count(*) FILTER (pb = 1 AND b = 1) AS BIGINT) AS n11 FROM c GROUP BY {by}),
  u AS (SELECT *, n01 / CAST(greatest(n00 + n01, 1) AS DOUBLE) AS p01, n11 / CAST(greatest(n10 + n11, 1) AS DOUBLE) AS p11, (n01 + n11) / CAST(n00 + n01 + n10 + n11 AS DOUBLE) AS pi FROM t),
  z AS (SELECT *, -2 * ((n00 + n10) * ln(greatest(1e-12, 1 - pi)) + (n01 + n11) * ln(greatest(1e-12, pi)) - n00 * ln(greatest(1e-12, 1 - p01)) - n01 * ln(greatest(1e-12, p01)) - n10 * ln(greatest(1e-12, 1 - p11)) - n11 * ln(greatest(1e-12, p11))) AS lr FROM u)"""


@query("i11_christoffersen", f"WITH {CHR.format(by='horizon', src='rr0')} SELECT CAST(horizon AS INT) AS horizon, n00, n01, n10, n11, r4(lr) AS christoffersen_lr FROM z")
def _(s):
    c = R.christoffersen(s.risk_rows(), ["horizon"], ORDER)
    return c.select("horizon", "n00", "n01", "n10", "n11", r4("christoffersen_lr").alias("christoffersen_lr"))


PIN = "avg(CASE WHEN realized_car >= pred_var THEN 0.05 * (realized_car - pred_var) ELSE -0.95 * (realized_car - pred_var) END)"


@query("i12_pinball", f"SELECT CAST(horizon AS INT) AS horizon, r6({PIN}) AS pinball_loss FROM rr0 GROUP BY 1")
def _(s):
    return s.risk_rows().groupBy("horizon").agg(r6(F.avg(R.pinball("realized_car", "pred_var", 0.05))).alias("pinball_loss"))


@query("i13_backtest_var", f"""SELECT CAST(horizon AS INT) AS horizon, event_type, n, k AS n_breach, r6(k / CAST(n AS DOUBLE)) AS breach_rate, r6(pin) AS pinball_loss, r6(mm) AS mdd_mae, r4({KUP}) AS kupiec_lr, {KUP} <= 3.841458820694124 AS passes_kupiec
  FROM (SELECT horizon, event_type, count(*) AS n, CAST(sum(CAST(realized_car < pred_var AS INT)) AS BIGINT) AS k, {PIN} AS pin, avg(abs(realized_mdd - pred_mdd)) AS mm FROM rr0 GROUP BY 1, 2)""")
def _(s):
    b = R.backtest_var(s.risk_rows(), ["horizon", "event_type"])
    return b.select("horizon", "event_type", "n", "n_breach", r6("breach_rate").alias("breach_rate"), r6("pinball_loss").alias("pinball_loss"),
                    r6("mdd_mae").alias("mdd_mae"), r4("kupiec_lr").alias("kupiec_lr"), "passes_kupiec")


@query("i14_vol_var", "SELECT event_id, industry_code, CAST(horizon AS INT) AS horizon, pred_var, r4(pred_es) AS pred_es FROM rr0")
def _(s):
    return s.risk_rows().select("event_id", "industry_code", "horizon", "pred_var", r4("pred_es").alias("pred_es"))


@query("i15_compare_var", f"""SELECT CAST(horizon AS INT) AS horizon, source, n, k AS n_breach, r6(pin) AS pinball_loss, r4({KUP}) AS kupiec_lr FROM (
  SELECT horizon, source, count(*) AS n, CAST(sum(CAST(realized_car < pred_var AS INT)) AS BIGINT) AS k, {PIN} AS pin FROM
  (SELECT *, 'candidate' AS source FROM rr0 UNION ALL SELECT *, 'legacy' FROM rw0) GROUP BY 1, 2)""")
def _(s):
    c = R.compare_var(s.risk_rows(0), s.risk_rows(0, WIDE), ["event_id", "industry_code", "horizon"])
    return c.select("horizon", "source", "n", "n_breach", r6("pinball_loss").alias("pinball_loss"), r4("kupiec_lr").alias("kupiec_lr"))


WIDE = {1: 1.4, 5: 0.6, 20: 0.6}


@query("i30_var_matrix", f"""WITH a AS (SELECT *, 'A' AS config, 0 AS seed FROM rr0 UNION ALL SELECT *, 'A', 1 FROM rr1 UNION ALL SELECT *, 'B', 0 FROM rw0 UNION ALL SELECT *, 'B', 1 FROM rw1),
  g AS (SELECT config, seed, count(*) AS n, CAST(sum(CAST(realized_car < pred_var AS INT)) AS BIGINT) AS k, {PIN} AS pin, avg(abs(realized_mdd - pred_mdd)) AS mm FROM a GROUP BY 1, 2),
  h AS (SELECT config, seed, k / CAST(n AS DOUBLE) AS breach_rate, {KUP} AS lr, pin, mm FROM g)
  SELECT config, seed, r6(avg(breach_rate)) AS breach_rate, r4(avg(lr)) AS kupiec_lr, r6(avg(pin)) AS pinball_loss, r6(avg(mm)) AS mdd_mae FROM h GROUP BY GROUPING SETS ((config, seed), (config))""")
def _(s):
    runs = [s.risk_rows(sd, sc).withColumns({"config": F.lit(c), "seed": F.lit(sd)}) for c, sc in (("A", None), ("B", WIDE)) for sd in (0, 1)]
    u = runs[0]
    for r in runs[1:]:
        u = u.unionByName(r)
    m = R.var_matrix(u)
    return m.select("config", "seed", r6("breach_rate").alias("breach_rate"), r4("kupiec_lr").alias("kupiec_lr"), r6("pinball_loss").alias("pinball_loss"), r6("mdd_mae").alias("mdd_mae"))
