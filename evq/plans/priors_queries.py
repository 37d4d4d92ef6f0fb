"""Prior queries (E1-E12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.functions.cols import r4, r6
from evq.operators import priors as P
from evq.plans.catalog import query

LBL = """pc AS (SELECT event_id, event_date, event_type || '/' || month(event_date) AS event_type, industry_code, car FROM car WHERE "window" = 5)"""


def labels(s):
    """Five-step labels with the event type refined by calendar month."""
    return s.car.filter("window = 5").select("event_id", "event_date", F.concat("event_type", F.lit("/"), F.month("event_date")).alias("event_type"), "industry_code", "car")


def _interp(x, pts):
    cs = " ".join(f"WHEN {x} <= {x1} THEN {y0}::DOUBLE + ({x} - {x0}::DOUBLE) * ({(y1 - y0) / (x1 - x0)!r}::DOUBLE)" for (x0, y0), (x1, y1) in zip(pts, pts[1:]))
    return f"CASE WHEN {x} <= {pts[0][0]} THEN {pts[0][1]}::DOUBLE {cs} ELSE {pts[-1][1]}::DOUBLE END"


def local_sql(src, keys, name):
    """Pair statistics over sums n, np, s, sp in `src`."""
    return f"""{name}0 AS (SELECT *, np / CAST(n AS DOUBLE) AS p, s / n AS av, CASE WHEN np > 0 THEN sp / np ELSE 0 END AS ap, CASE WHEN n > np THEN (s - sp) / (n - np) ELSE 0 END AS an FROM {src} WHERE n > 0),
    {name}1 AS (SELECT *, CASE WHEN ap > 0 AND an < 0 THEN abs(an) / abs(ap) END AS r, CASE WHEN abs(av) >= 0.005 AND sign(p - 0.5) * sign(av) > 0 THEN {_interp('p', P.ANCHORS)} ELSE 0 END AS s0 FROM {name}0),
    {name} AS (SELECT *, CASE WHEN p >= 0.3 AND p < 0.45 AND r >= 0.6 AND r <= 0.8 THEN {_interp('r', ((0.60, -0.3), (0.80, -0.2)))} ELSE s0 END AS sl FROM {name}1)"""


SUMS = "count(*) AS n, count(*) FILTER (car >= 0) AS np, sum(car) AS s, sum(CASE WHEN car >= 0 THEN car ELSE 0 END) AS sp"
STATS = f"{LBL}, b0 AS (SELECT event_type, industry_code, {SUMS} FROM pc GROUP BY 1, 2), {local_sql('b0', '', 'st')}"


@query("e1_e2_e3_pair_stats", f"WITH {STATS} SELECT event_type, industry_code, n, r6(p) AS p_pos, r4(av) AS avg_car, r6(r) AS asymmetry_r, r6(sl) AS s_local FROM st")
def _(s):
    p = P.pair_stats(labels(s))
    return p.select("event_type", "industry_code", "n", *[r6(c).alias(c) for c in ("p_pos", "asymmetry_r", "s_local")], r4("avg_car").alias("avg_car"))


def shrink_sql(st, keys=""):
    k = f"{keys}, " if keys else ""
    on = f"{keys}, " if keys else ""
    return f"""pe AS (SELECT {k}event_type, avg(CASE WHEN n >= 2 THEN sl END) AS me, count(*) FILTER (n >= 3) AS nd FROM {st} GROUP BY {k}event_type),
    pi_ AS (SELECT {k}industry_code, avg(CASE WHEN n >= 2 THEN sl END) AS mi FROM {st} GROUP BY {k}industry_code),
    sh AS (SELECT *, least(1.2, greatest(-1.2, least(1, n / 5.0::DOUBLE) * sl + (1 - least(1, n / 5.0::DOUBLE)) * (0.5 * coalesce(me, 0) + 0.5 * coalesce(mi, 0)))) AS sv
      FROM {st} JOIN pe USING ({on}event_type) JOIN pi_ USING ({on}industry_code)),
    sens AS (SELECT *, round(round(sv, 9), 3) AS sensitivity FROM sh WHERE nd >= 2 AND abs(sv) >= 0.05)"""


@query("e4_shrinkage_prior", f"WITH {STATS}, {shrink_sql('st')} SELECT event_type, industry_code, n, r6(sl) AS s_local, r6(sensitivity) AS sensitivity FROM sens")
def _(s):
    p = P.shrinkage_prior(labels(s))
    return p.select("event_type", "industry_code", "n", r6("s_local").alias("s_local"), r6("sensitivity").alias("sensitivity"))


@query("e5_prior_asof", f"""WITH {LBL}, dl AS (SELECT event_type, industry_code, event_date, {SUMS} FROM pc GROUP BY 1, 2, 3),
  ks AS (SELECT DISTINCT event_type, event_date AS t FROM pc),
  b0 AS (SELECT t, event_type, industry_code, CAST(sum(n) AS BIGINT) AS n, CAST(sum(np) AS BIGINT) AS np, sum(s) AS s, sum(sp) AS sp FROM (SELECT DISTINCT event_date AS t FROM pc) JOIN dl ON dl.event_date < t GROUP BY 1, 2, 3),
  {local_sql('b0', '', 'st')}, {shrink_sql('st', 't')}
  SELECT pc.event_id, pc.industry_code, CAST(coalesce(st.n, 0) AS BIGINT) AS n_past, r6(sensitivity) AS sensitivity FROM pc LEFT JOIN st ON st.t = event_date AND st.event_type = pc.event_type AND st.industry_code = pc.industry_code
  LEFT JOIN sens ON sens.t = event_date AND sens.event_type = pc.event_type AND sens.industry_code = pc.industry_code""")
def _(s):
    lb = labels(s)
    return P.prior_asof(lb.drop("car"), lb).select("event_id", "industry_code", F.col("n_past").cast("long").alias("n_past"), r6("sensitivity").alias("sensitivity"))


@query("e6_prior_loo", f"""WITH {STATS}, own AS (SELECT event_id, event_type, industry_code, car FROM pc),
  b1 AS (SELECT o.event_id, o.event_type, o.industry_code, st.n - 1 AS n, st.np - CAST(o.car >= 0 AS INT) AS np, st.s - o.car AS s, st.sp - CASE WHEN o.car >= 0 THEN o.car ELSE 0 END AS sp FROM own o JOIN st USING (event_type, industry_code)),
  {local_sql('b1', '', 'lo')},
  wide AS (SELECT e.event_id, e.event_type AS et, st.event_type, st.industry_code, coalesce(lo.n, CASE WHEN o.event_id IS NULL THEN st.n ELSE 0 END) AS n, coalesce(lo.sl, CASE WHEN o.event_id IS NULL THEN st.sl ELSE 0 END) AS sl, o.event_id IS NOT NULL AS mine
    FROM (SELECT DISTINCT event_id, event_type FROM pc) e JOIN st ON st.event_type = e.event_type LEFT JOIN own o ON o.event_id = e.event_id AND o.industry_code = st.industry_code
    LEFT JOIN lo ON lo.event_id = e.event_id AND lo.industry_code = st.industry_code),
  te AS (SELECT event_id, avg(CASE WHEN n >= 2 THEN sl END) AS me, count(*) FILTER (n >= 3) AS nd FROM wide GROUP BY 1),
  ti AS (SELECT industry_code, sum(CASE WHEN n >= 2 THEN sl ELSE 0 END) AS si, count(*) FILTER (n >= 2) AS ni FROM st GROUP BY 1),
  fin AS (SELECT w.event_id, w.industry_code, w.n, w.sl, me, nd, (si - CASE WHEN st.n >= 2 THEN st.sl ELSE 0 END + CASE WHEN w.n >= 2 THEN w.sl ELSE 0 END) AS sx, ni - CAST(st.n >= 2 AS INT) + CAST(w.n >= 2 AS INT) AS nx
    FROM wide w JOIN te USING (event_id) JOIN ti ON ti.industry_code = w.industry_code JOIN st ON st.event_type = w.event_type AND st.industry_code = w.industry_code WHERE mine),
  sv AS (SELECT *, least(1.2, greatest(-1.2, least(1, n / 5.0::DOUBLE) * sl + (1 - least(1, n / 5.0::DOUBLE)) * (0.5 * coalesce(me, 0) + 0.5 * coalesce(sx / nullif(nx, 0), 0)))) AS v FROM fin)
  SELECT event_id, industry_code, CAST(n AS BIGINT) AS n_rest, CASE WHEN n > 0 AND nd >= 2 AND abs(v) >= 0.05 THEN r6(round(round(v, 9), 3)) END AS sensitivity FROM sv""")
def _(s):
    p = P.prior_loo(labels(s))
    return p.select("event_id", "industry_code", "n_rest", r6("sensitivity").alias("sensitivity"))


@query("e7_prior_oot", f"""WITH {LBL}, b0 AS (SELECT event_type, industry_code, {SUMS} FROM pc WHERE year(event_date) <= 1998 GROUP BY 1, 2), {local_sql('b0', '', 'st')}, {shrink_sql('st')}
  SELECT event_id, industry_code, r6(sensitivity) AS sensitivity, (sensitivity >= 0) = (car >= 0) AS hit FROM pc JOIN sens USING (event_type, industry_code) WHERE year(event_date) > 1998""")
def _(s):
    return P.prior_oot(labels(s), 1998).select("event_id", "industry_code", r6("sensitivity").alias("sensitivity"), "hit")


@query("e8_apply_prior", f"WITH {STATS}, {shrink_sql('st')} SELECT event_id, industry_code, r6(greatest(coalesce(sensitivity, 1), 0)) AS sensitivity FROM pc LEFT JOIN sens USING (event_type, industry_code)")
def _(s):
    lb = labels(s)
    return P.apply_prior(lb, P.shrinkage_prior(lb), clamp_negative=True).select("event_id", "industry_code", r6("sensitivity").alias("sensitivity"))


CONV = f"""{LBL}, dl AS (SELECT event_type, industry_code, event_date, count(*) AS n, count(*) FILTER (car >= 0) AS np FROM pc GROUP BY 1, 2, 3),
  cu AS (SELECT event_type, industry_code, event_date, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS n, sum(np) OVER w AS np FROM dl WINDOW w AS (PARTITION BY event_type, industry_code ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  cv AS (SELECT event_id, industry_code, event_type, n, coalesce(2 * abs(np / CAST(nullif(n, 0) AS DOUBLE) - 0.5), 0) AS c FROM pc JOIN cu USING (event_type, industry_code, event_date))"""


def convicted(s):
    lb = labels(s)
    return P.conviction(lb, lb)


@query("e9_conviction", f"WITH {CONV} SELECT event_id, industry_code, n AS n_past, r6(c) AS conviction FROM cv")
def _(s):
    return convicted(s).select("event_id", "industry_code", "n_past", r6("conviction").alias("conviction"))


NET = "((event_id * 31 % 41 - 20) / 7.0::DOUBLE)"
PD = "CAST(ascii(industry_code) % 3 - 1 AS INT)"


def signalled(s):
    """Scenarios with a derived net signal and a prior per industry."""
    return convicted(s).withColumns({
        "net_signal": (F.col("event_id") * 31 % 41 - 20) / F.lit(7.0), "prior_direction": (F.ascii("industry_code") % 3 - 1).cast("int"),
        "prior_strength": (F.ascii("industry_code") % 3 - 1) * F.length("industry_code") / F.lit(9.0), "prior_verified": F.length("industry_code") != 5})


@query("e10_recalibrate_strength", f"WITH {CONV} SELECT event_id, industry_code, r6(CASE WHEN n = 0 THEN 0 WHEN n < 3 THEN 0.3 ELSE 1 END * c * {PD} * length(industry_code) / 9.0) AS strength FROM cv")
def _(s):
    x = signalled(s)
    return x.select("event_id", "industry_code", r6(P.recalibrate_strength(F.col("prior_strength"), F.col("conviction"), F.col("n_past"))).alias("strength"))


def tanh_sql(x):
    return f"((exp(2 * ({x})) - 1) / (exp(2 * ({x})) + 1))"


BL = f"""bl AS (SELECT *, {NET} AS x, {PD} AS pd, CASE WHEN n = 0 THEN 0 WHEN n < 3 THEN 0.3 ELSE 1 END * c * {PD} * length(industry_code) / 9.0 AS st FROM cv),
  bt AS (SELECT *, {tanh_sql('x / 2')} AS own, CASE WHEN abs(x) > 1e-6 THEN abs(x) ELSE 1 END AS env FROM bl)"""


@query("e11_blend_prior_soft", f"""WITH {CONV}, {BL}, m AS (SELECT *, 0.65::DOUBLE * own + 0.35::DOUBLE * CASE WHEN pd = 0 THEN st ELSE pd * abs(st) END AS mix FROM bt)
  SELECT event_id, industry_code, r4(CASE WHEN abs(own) > 1e-6 THEN mix * env / abs(own) ELSE mix * env END) AS blended FROM m""")
def _(s):
    return P.blend_prior(signalled(s), "soft").select("event_id", "industry_code", r4("blended").alias("blended"))


@query("e12_blend_prior_gated", f"""WITH {CONV}, {BL}, m AS (SELECT *, CASE WHEN length(industry_code) = 5 THEN 'unverified' WHEN pd = 0 OR n < 3 OR c <= 0 THEN 'abstain' ELSE 'gated' END AS reason, 0.6::DOUBLE * c AS lam FROM bt)
  SELECT event_id, industry_code, reason, r6(CASE WHEN reason = 'gated' THEN ((1 - lam) * own + lam * pd * c) * env / greatest(abs(own), 1e-6) ELSE x END) AS blended FROM m""")
def _(s):
    return P.blend_prior(signalled(s), "gated").select("event_id", "industry_code", "reason", r6("blended").alias("blended"))
