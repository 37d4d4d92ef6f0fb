"""Event-study queries (D rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.functions.cols import r4, r6
from evq.operators import events as E
from evq.plans.catalog import query

RULES = (("(?i)there", ("ECONOMY", "SMALL")), ("(?i)tion", ("MEDIUM",)), ("(?i)ing\\b", ("PROMO", "MEDIUM")),
         ("(?i)that", ("LARGE", "ECONOMY")), ("(?i)leux", ("STANDARD",)))
BANNED = "(?i)there|tion|leux"

LISTED = """SELECT event_id, event_date, event_type, direction, string_agg(industry_code, ',' ORDER BY industry_code) AS affected_industries
  FROM scn GROUP BY ALL"""


def listed(s):
    return s.scn.groupBy("event_id", "event_date", "event_type", "direction").agg(
        F.array_join(F.sort_array(F.collect_list("industry_code")), ",").alias("affected_industries"))


@query("d1_scenarios", f"""SELECT event_id, event_date, event_type, code AS industry_code
  FROM (SELECT *, unnest(string_split(affected_industries, ',')) AS code FROM ({LISTED})) WHERE code IN (SELECT industry_code FROM px)""")
def _(s):
    return E.scenarios(listed(s), s.px).select("event_id", "event_date", "event_type", "industry_code")


@query("d2_car_diff", 'SELECT event_id, event_date, industry_code, "window", t0, cum_ind_ret, cum_mkt_ret, car FROM car')
def _(s):
    return s.car.select("event_id", "event_date", "industry_code", "window", "t0", "cum_ind_ret", "cum_mkt_ret", "car")


def _path_sql(n: str) -> str:
    return f"""WITH p AS (SELECT industry_code, event_date, t0, h, day_idx, sum(ln((1 + coalesce(r, 0)) / (1 + coalesce(m, 0)))) OVER w AS lg,
    sum(ln(1 + coalesce(r, 0))) OVER w AS li, sum(ln(1 + coalesce(m, 0))) OVER w AS lm
    FROM probe JOIN anch USING (event_date) CROSS JOIN (VALUES (1), (5), (20)) g(h) JOIN ret USING (industry_code)
    WHERE day_idx BETWEEN t0_idx AND t0_idx + {n} - 1 WINDOW w AS (PARTITION BY industry_code, event_date, h ORDER BY day_idx)),
  q AS (SELECT *, greatest(1.0, max(exp(lg)) OVER (PARTITION BY industry_code, event_date, h ORDER BY day_idx)) AS peak FROM p),
  a AS (SELECT industry_code, event_date, t0, h AS horizon, count(*) AS n_returns, arg_max(lg, day_idx) AS lg, arg_max(li, day_idx) AS li,
    arg_max(lm, day_idx) AS lm, max((peak - exp(lg)) / peak) AS mdd FROM q GROUP BY 1, 2, 3, 4 HAVING count(*) = (CASE h WHEN 1 THEN {n.replace('h', '1')} WHEN 5 THEN {n.replace('h', '5')} ELSE {n.replace('h', '20')} END))
  SELECT event_id, industry_code, t0, horizon, CAST(n_returns AS INT) AS n_returns, r6(exp(lg) - 1) AS realized_car, r6(mdd) AS realized_mdd,
    r6(greatest(1 - exp(lg), 0)) AS realized_downside, r6(exp(li) - 1) AS industry_cum, r6(exp(lm) - 1) AS market_cum
  FROM scn JOIN a USING (industry_code, event_date)"""


def _paths(s, inclusive):
    p = E.realized_path(s.scn, s.px, s.mkt, inclusive_end=inclusive)
    return p.select("event_id", "industry_code", "t0", "horizon", "n_returns", *[
        r6(c).alias(c) for c in ("realized_car", "realized_mdd", "realized_downside", "industry_cum", "market_cum")])


@query("d3_realized_path", _path_sql("(h + 1)"))
def _(s):
    return _paths(s, True)


@query("d4_realized_path_exclusive", _path_sql("h"))
def _(s):
    return _paths(s, False)


@query("d5_car_summary", """SELECT 'all' AS direction, "window", r6(avg(car)) AS mean_car, r6(stddev_samp(car)) AS std_car, count(*) AS n FROM car GROUP BY 2
  UNION ALL SELECT '+', "window", r6(avg(car)), r6(stddev_samp(car)), count(*) FROM car WHERE direction = '+' GROUP BY 2""")
def _(s):
    def one(d):
        return E.car_summary(s.car, None if d == "all" else d).select(
            F.lit(d).alias("direction"), "window", r6("mean_car").alias("mean_car"), r6("std_car").alias("std_car"), "n")
    return one("all").unionByName(one("+"))


@query("d6_car_top", 'SELECT event_date, event_id, industry_code, car FROM car WHERE "window" = 5 ORDER BY car DESC, event_date, event_id, industry_code LIMIT 10')
def _(s):
    return E.car_top(s.car)


@query("d7_cell_stats", """SELECT event_type, industry_code, count(*) AS n, r6(avg(CASE WHEN car >= 0 THEN 1 ELSE 0 END)) AS p_pos, r6(avg(car)) AS mean_car,
  any_value(n_parts) AS n_parts FROM car JOIN (SELECT p_type AS industry_code, count(*) AS n_parts FROM part GROUP BY 1) USING (industry_code)
  WHERE "window" = 5 GROUP BY 1, 2""")
def _(s):
    names = s.t("part").groupBy(F.col("p_type").alias("industry_code")).agg(F.count("*").alias("n_parts"))
    return E.cell_stats(s.car, 5, names).select("event_type", "industry_code", "n", r6("p_pos").alias("p_pos"), r6("mean_car").alias("mean_car"), "n_parts")


@query("d8_car_decomposition", """SELECT event_type, count(*) AS n, r6(avg(cum_ind_ret)) AS mean_abs, r6(avg(cum_mkt_ret)) AS mean_mkt, r6(avg(car)) AS mean_rel,
  r6(avg(CAST(cum_ind_ret > 0 AS INT))) AS pos_abs, r6(avg(CAST(cum_mkt_ret > 0 AS INT))) AS pos_mkt, r6(avg(CAST(car > 0 AS INT))) AS pos_rel
  FROM car WHERE "window" = 5 GROUP BY 1""")
def _(s):
    d = E.car_decomposition(s.car)
    return d.select("event_type", "n", *[r6(c).alias(c) for c in d.columns if c[:4] in ("mean", "pos_")])


def _rule_sql():
    rows = ", ".join(f"({i}, '{p}', {j}, '{c}')" for i, (p, cs) in enumerate(RULES) for j, c in enumerate(cs))
    return f"""WITH rules(rp, pat, cp, code) AS (VALUES {rows}),
  hit AS (SELECT doc_id, code, min(rp * 10 + cp) AS pos FROM docs JOIN rules ON regexp_matches(text, pat) GROUP BY 1, 2),
  lst AS (SELECT doc_id, string_agg(code, ',' ORDER BY pos) AS industries, count(*) AS n_map FROM hit GROUP BY 1)
  SELECT doc_id, coalesce(industries, '') AS industries, CAST(coalesce(n_map, 0) AS INT) AS n_map FROM docs LEFT JOIN lst USING (doc_id)"""


@query("d9_map_industries", _rule_sql())
def _(s):
    return E.map_industries(s.docs, RULES).select("doc_id", F.array_join("industries", ",").alias("industries"), "n_map")


@query("d10_banned_words", f"""SELECT doc_id, array_to_string(regexp_extract_all(text, '{BANNED}'), '|') AS banned,
  CAST(len(regexp_extract_all(text, '{BANNED}')) AS INT) AS n_banned FROM docs""")
def _(s):
    return E.banned_words(s.docs, BANNED).select("doc_id", "banned", "n_banned")


@query("d11_merge_events", f"""WITH l AS ({LISTED}), o AS (SELECT * FROM l WHERE event_type IN ('1-URGENT', '2-HIGH')),
  c AS (SELECT e.event_id, e.event_date, e.event_type, l.affected_industries FROM ev e LEFT JOIN l USING (event_id) WHERE e.event_type NOT IN ('1-URGENT', '2-HIGH'))
  SELECT event_id, event_date, event_type, affected_industries, direction, 'orig' AS origin FROM o
  UNION ALL SELECT event_id, event_date, event_type, affected_industries, '', 'added' FROM c
  WHERE affected_industries <> '' AND event_date NOT IN (SELECT event_date FROM o)""")
def _(s):
    lst = listed(s)
    head = F.col("event_type").isin("1-URGENT", "2-HIGH")
    cand = s.ev.filter(~head).join(lst.select("event_id", "affected_industries"), "event_id", "left")
    return E.merge_events(lst.filter(head), cand).select("event_id", "event_date", "event_type", "affected_industries", "direction", "origin")


@query("d12_type_counts", "SELECT event_type, count(*) AS n FROM ev GROUP BY 1")
def _(s):
    return E.type_counts(s.ev)


@query("d13_split_corpus", """SELECT CASE WHEN doc_type = 'mechanism' OR pub_date IS NULL THEN 'quarantine' ELSE 'event' END AS part,
  count(*) AS n, min(pub_date) AS first_pub, max(pub_date) AS last_pub FROM docs GROUP BY 1""")
def _(s):
    return E.corpus_spans(E.split_corpus(s.docs))


@query("d14_attach_event_type", """SELECT event_id, event_date, industry_code, prob_up, l.event_type FROM res1 r LEFT JOIN
  (SELECT event_date, industry_code, min(event_type) AS event_type FROM car WHERE "window" = 5 GROUP BY 1, 2) l USING (event_date, industry_code)""")
def _(s):
    return E.attach_event_type(s.res(1), s.car).select("event_id", "event_date", "industry_code", "prob_up", "event_type")


def match_sql(a: str, b: str) -> str:
    """The sets of a one after another; each takes its best b set that none before it took."""
    return f"""WITH RECURSIVE a AS ({a}), b AS ({b}), ia AS (SELECT a_id, row_number() OVER (ORDER BY a_id) AS k, count(*) AS na FROM a GROUP BY a_id), ib AS (SELECT b_id, count(*) AS nb FROM b GROUP BY b_id),
  n AS (SELECT a_id, b_id, count(*) AS n FROM a JOIN b USING (item) GROUP BY 1, 2),
  w AS (SELECT k, list({{'b': b_id, 'j': coalesce(n, 0) / CAST(na + nb - coalesce(n, 0) AS DOUBLE)}} ORDER BY coalesce(n, 0) / CAST(na + nb - coalesce(n, 0) AS DOUBLE) DESC, b_id) AS l FROM ia CROSS JOIN ib LEFT JOIN n USING (a_id, b_id) GROUP BY k),
  r AS (SELECT 0 AS k, list_value((SELECT min(b_id) FROM b))[1:0] AS used, NULL::STRUCT(b VARCHAR, j DOUBLE) AS x
    UNION ALL SELECT k, CASE WHEN x IS NULL THEN used ELSE list_append(used, x.b) END, x FROM (SELECT w.k, used, list_filter(l, lambda e: NOT list_contains(used, e.b))[1] AS x FROM r JOIN w ON w.k = r.k + 1))
  SELECT a_id, x.b AS b_id, r6(x.j) AS jaccard, coalesce(x.j = 1, false) AS exact FROM r JOIN ia USING (k)"""


@query("d15_match_sets", match_sql("SELECT DISTINCT s_nationkey AS a_id, p_brand AS item FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey", "SELECT DISTINCT p_type AS b_id, p_brand AS item FROM part"))
def _(s):
    pt = s.t("part").select("p_partkey", "p_brand", "p_type")
    a = s.t("lineitem").join(s.t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(pt, F.col("l_partkey") == F.col("p_partkey"))
    a = a.select(F.col("s_nationkey").alias("a_id"), F.col("p_brand").alias("item"))
    b = pt.select(F.col("p_type").alias("b_id"), F.col("p_brand").alias("item"))
    return E.match_sets(a, b).withColumn("jaccard", r6("jaccard"))


@query("d15_match_sets_left_over", match_sql("SELECT DISTINCT p_brand AS a_id, p_size AS item FROM part WHERE p_size % 10 <> 0 OR p_brand < 'Brand#3'", "SELECT DISTINCT p_type AS b_id, p_size AS item FROM part WHERE p_size % 10 = 0"))
def _(s):
    """More sets than partners, some without a shared item."""
    pt = s.t("part")
    a, b = (pt.select(F.col(c).alias(k), F.col("p_size").alias("item")) for c, k in (("p_brand", "a_id"), ("p_type", "b_id")))
    return E.match_sets(a.filter("item % 10 <> 0 or a_id < 'Brand#3'"), b.filter("item % 10 = 0")).withColumn("jaccard", r6("jaccard"))
