"""Signal queries (E13-E28): stored responses, text factors, fusion, path correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.functions.cols import r4, r6
from evq.operators import features as X
from evq.operators import signals as S
from evq.plans.catalog import query
from evq.plans.features_queries import FSTATE, VSTATE, asof_sql
from evq.plans.priors_queries import tanh_sql

POS, NEG = ("there", "tion", "hound", "ing "), ("leux", "eaux", "thou", "ver")
UP, DOWN = ("good", "there", "hand"), ("bad", "tion")
MAG = (("高", ("thousand", "high")), ("中", ("there", "mid")), ("低", ("low", "is ")))


def chain_resp(s):
    """Each order's lines as a stored reasoning chain in JSON text."""
    q = F.col("l_quantity")
    step = F.struct(
        F.col("l_linenumber").alias("step"), F.concat("l_returnflag", "l_linestatus").alias("entity"), F.col("l_linestatus").alias("industry_code"),
        F.round(1 - F.col("l_discount") * 5, 2).alias("confidence"), F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise("?").alias("impact_direction"),
        F.when(q < 15, "低").when(q < 35, "中").when(q < 48, "高").otherwise("未知").alias("impact_magnitude"))
    rows = s.t("lineitem").groupBy(F.col("l_orderkey").alias("response_id")).agg(F.sort_array(F.collect_list(step)).alias("chain"))
    return rows.select("response_id", F.concat(F.lit("answer:\n"), F.to_json(F.struct("chain")), F.lit("\nend")).alias("content"))


STEPS = """stp AS (SELECT l_orderkey AS response_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag || l_linestatus, round(1 - l_discount * 5, 2), CASE WHEN l_quantity < 15 THEN '低' WHEN l_quantity < 35 THEN '中' WHEN l_quantity < 48 THEN '高' ELSE '未知' END) AS pos, l_returnflag || l_linestatus AS entity, l_linestatus AS industry_code, round(1 - l_discount * 5, 2) AS c,
  CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS d, CASE WHEN l_quantity < 15 THEN 0.2::DOUBLE WHEN l_quantity < 35 THEN 0.5 WHEN l_quantity < 48 THEN 0.9 ELSE 0 END AS m FROM lineitem)"""
FAC = STEPS + """, fac AS (SELECT response_id, entity, arg_max((CASE WHEN d = 1 THEN 1 ELSE -1 END) * m * c, pos) AS factor FROM stp GROUP BY 1, 2)"""
CEL = """cel AS (SELECT response_id, industry_code, max(m) AS magnitude, max(c) AS confidence, coalesce(arg_min(d, pos) FILTER (d <> 0), 0) AS direction FROM stp GROUP BY 1, 2)"""


@query("e13_factors_from_chain", f"WITH {FAC} SELECT response_id, entity, r6(factor) AS factor FROM fac")
def _(s):
    return S.factors_from_chain(S.parse_chain(chain_resp(s))).select("response_id", "entity", r6("factor").alias("factor"))


@query("e14_transmission_agg", f"""WITH {FAC}, {CEL}, f AS (SELECT response_id, sum(factor) AS net, arg_max(factor, (abs(factor), entity)) AS es FROM fac GROUP BY 1),
  k AS (SELECT response_id, CASE WHEN count(*) >= 2 THEN stddev_pop(direction * magnitude * confidence) ELSE 0 END AS dis, count(*) FILTER (direction <> 0) AS cov FROM cel GROUP BY 1)
  SELECT response_id, r6(net) AS net_signal, r6(es) AS event_strength, CAST(sign(round(net, 12)) AS INT) AS net_direction, r6(dis) AS dispersion, cov AS coverage FROM f JOIN k USING (response_id)""")
def _(s):
    steps = S.parse_chain(chain_resp(s))
    t = S.transmission_agg(S.factors_from_chain(steps), S.transmission_cells(steps))
    return t.select("response_id", r6("net_signal").alias("net_signal"), r6("event_strength").alias("event_strength"), "net_direction", r6("dispersion").alias("dispersion"), "coverage")


@query("e15_transmission_cells", f"WITH {STEPS}, {CEL} SELECT response_id, industry_code, r6(magnitude) AS magnitude, r6(confidence) AS confidence, CAST(direction AS INT) AS direction FROM cel")
def _(s):
    c = S.transmission_cells(S.parse_chain(chain_resp(s)))
    return c.select("response_id", "industry_code", r6("magnitude").alias("magnitude"), r6("confidence").alias("confidence"), "direction")


def hits_sql(col, words):
    return "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in words) + ")"


TF = f"""h AS (SELECT doc_id, {hits_sql('text', POS)} AS p, {hits_sql('text', NEG)} AS n FROM docs),
  g AS (SELECT *, CASE WHEN greatest(p, n) >= 3 THEN 0.9::DOUBLE WHEN greatest(p, n) >= 2 THEN 0.55 ELSE 0.3 END AS mg, CASE WHEN p = n THEN 0.4::DOUBLE ELSE 0.7 END AS cf FROM h WHERE p > 0 OR n > 0),
  tf AS (SELECT doc_id, 'text_positive' AS name, mg AS value, cf AS confidence, mg * cf AS sv FROM g WHERE p > 0 UNION ALL SELECT doc_id, 'text_negative', mg, cf, -mg * cf FROM g WHERE n > 0
    UNION ALL SELECT doc_id, 'text_mixed', 0.2, 0.35, 0.2::DOUBLE * 0.35 FROM g WHERE p = n)"""


@query("e16_text_factors", f"WITH {TF} SELECT doc_id, name, r6(value) AS value, r6(confidence) AS confidence, r6(sv) AS signed_value FROM tf")
def _(s):
    t = S.text_factors(s.docs, POS, NEG)
    return t.select("doc_id", "name", r6("value").alias("value"), r6("confidence").alias("confidence"), r6("signed_value").alias("signed_value"))


def vtext(s):
    """Documents with their quality label appended as a stated confidence."""
    lb = s.t("labels").select("doc_id", F.concat(F.lit(" confidence: 0."), F.col("quality") * 3 + F.col("toxic") + 2).alias("tail"))
    return s.docs.join(lb, "doc_id", "left").select("doc_id", F.concat("text", F.coalesce("tail", F.lit(""))).alias("text"), F.when(F.col("lang") == "en", "+").when(F.col("lang") == "fr", "-").otherwise("").alias("hint"))


VT = """vt AS (SELECT d.doc_id, d.text || coalesce(' confidence: 0.' || CAST(quality * 3 + toxic + 2 AS VARCHAR), '') AS text, CASE lang WHEN 'en' THEN '+' WHEN 'fr' THEN '-' ELSE '' END AS hint FROM docs d LEFT JOIN labels l USING (doc_id))"""


@query("e17_text_direction", f"""WITH {VT}, h AS (SELECT *, {hits_sql('text', UP)} + CAST(hint = '+' AS INT) AS p, {hits_sql('text', DOWN)} + CAST(hint = '-' AS INT) AS n FROM vt)
  SELECT doc_id, CASE WHEN n > p THEN '-' WHEN p > n THEN '+' WHEN hint <> '' THEN hint ELSE '?' END AS direction,
   CASE {' '.join(f"WHEN {hits_sql('text', ws)} > 0 THEN '{m}'" for m, ws in MAG)} ELSE '未知' END AS magnitude,
   r6(CASE WHEN regexp_extract(text, 'confidence: \\s*(0\\.\\d+|1\\.0)', 1) <> '' THEN CAST(regexp_extract(text, 'confidence: \\s*(0\\.\\d+|1\\.0)', 1) AS DOUBLE)
     WHEN regexp_extract(text, '(0\\.\\d+)', 1) <> '' THEN CAST(regexp_extract(text, '(0\\.\\d+)', 1) AS DOUBLE) ELSE 0.5 END) AS confidence FROM h""")
def _(s):
    v = vtext(s)
    t = F.col("text")
    return v.select("doc_id", S.text_direction(t, F.col("hint"), 1, UP, DOWN).alias("direction"), S.text_magnitude(t, MAG).alias("magnitude"),
                    r6(S.text_confidence(t, "confidence: ")).alias("confidence"))


def verdict_resp(s):
    """Event rows as stored verdicts: plain JSON, fenced JSON, bare marks or prose."""
    k = F.get_json_object("props", "$.k").cast("int")
    body = F.to_json(F.struct(F.when(k % 2 == 0, "+").otherwise("-").alias("direction"), (k / 100).alias("confidence"), (k % 7 == 0).alias("contested"),
                              F.when(k < 30, "低").when(k < 70, "中").otherwise("高").alias("magnitude")))
    t = F.col("event_type")
    content = (F.when(t == "click", body).when(t == "view", F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(t == "purchase", F.concat(F.lit("+ likely "), k)).otherwise(F.lit("no idea")))
    return s.t("events").select(F.col("event_id").alias("response_id"), content.alias("content"))


EK = "e0 AS (SELECT event_id AS response_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


@query("e18_normalize_verdicts", f"""WITH {EK}, v AS (SELECT response_id, CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END WHEN event_type = 'purchase' THEN '+' END AS direction,
   CASE WHEN event_type IN ('click', 'view') THEN k / 100.0::DOUBLE WHEN event_type = 'purchase' THEN 0.5 END AS cf, event_type IN ('click', 'view') AND k % 7 = 0 AS ct,
   CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN k < 30 THEN 0.2::DOUBLE WHEN k < 70 THEN 0.5 ELSE 0.9 END WHEN event_type = 'purchase' THEN 0.5 END AS mg FROM e0)
  SELECT response_id, direction, r6(cf) AS confidence, ct AS contested, direction IS NULL OR ct OR cf < 0.3 AS abstained,
   r6(CASE WHEN direction IS NULL OR ct OR cf < 0.3 THEN 0 ELSE (CASE direction WHEN '+' THEN 1 ELSE -1 END) * mg * cf END) AS signal FROM v""")
def _(s):
    v = S.normalize_verdicts(verdict_resp(s))
    return v.select("response_id", "direction", r6("confidence").alias("confidence"), "contested", "abstained", r6("signal").alias("signal"))


def rel_resp(s):
    k = F.get_json_object("props", "$.k").cast("int")
    bm = F.when(k % 3 == 0, "+").when(k % 3 == 1, "-").otherwise("unsure")
    body = F.to_json(F.struct(bm.alias("beats_market"), F.when(k % 2 == 0, "+").otherwise("-").alias("r_ind"), F.when(k % 5 < 3, "+").otherwise("-").alias("r_mkt"), (k / 100).alias("confidence"), F.lit("高").alias("magnitude")))
    return s.t("events").select(F.col("event_id").alias("response_id"), body.alias("content"))


@query("e19_normalize_reldecomp", f"""WITH {EK}, r AS (SELECT response_id, k, CASE WHEN k % 3 = 0 THEN '+' WHEN k % 3 = 1 THEN '-' WHEN k % 2 = 0 AND k % 5 >= 3 THEN '+' WHEN k % 2 = 1 AND k % 5 < 3 THEN '-' END AS bm, (k % 2 = 0) <> (k % 5 < 3) AS df FROM e0)
  SELECT response_id, bm AS beats_market, r6(CASE bm WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END * 0.9::DOUBLE * k / 100) AS signal, CASE WHEN bm IS NOT NULL THEN df END AS differs FROM r""")
def _(s):
    r = S.normalize_reldecomp(rel_resp(s))
    return r.select("response_id", "beats_market", r6("signal").alias("signal"), "differs")


@query("e20_parse_direction", """WITH a AS (SELECT conv_id, turn, trim(text) AS t, substr(trim(text), 1, 30) AS hd FROM conversations)
  SELECT conv_id, turn, CASE WHEN contains(hd, 'on') OR contains(hd, 'qu') OR contains(lower(hd), 'positive') THEN '+' WHEN contains(hd, 'er') OR contains(hd, 'la') OR contains(lower(hd), 'negative') THEN '-'
   WHEN (length(t) - length(replace(t, 'on', ''))) / 2 + (length(t) - length(replace(t, 'qu', ''))) / 2 >= (length(t) - length(replace(t, 'er', ''))) / 2 + (length(t) - length(replace(t, 'la', ''))) / 2 THEN '+' ELSE '-' END AS direction FROM a""")
def _(s):
    return s.t("conversations").select("conv_id", "turn", S.parse_direction(F.col("text"), ("on", "qu"), ("er", "la")).alias("direction"))


BAL = f"""{TF}, bal AS (SELECT doc_id, sum(greatest(sv, 0)) AS bull, sum(greatest(-sv, 0)) AS bear FROM tf GROUP BY 1)"""


@query("e21_factor_balance", f"WITH {BAL} SELECT doc_id, r6(bull) AS bull, r6(bear) AS bear, r6(bull - bear) AS net, r6(least(1, 2 * least(bull, bear) / (bull + bear))) AS disagreement FROM bal")
def _(s):
    b = S.factor_balance(S.text_factors(s.docs, POS, NEG), ["doc_id"])
    return b.select("doc_id", *[r6(c).alias(c) for c in ("bull", "bear", "net", "disagreement")])


@query("e22_disagreement", f"SELECT event_id, industry_code, r6(least(1, greatest(0, abs({tanh_sql('(prob_up - 0.5)')} - {tanh_sql('car * 5')})))) AS disagreement FROM res0")
def _(s):
    return s.res(0).select("event_id", "industry_code", r6(S.disagreement(F.col("prob_up") - 0.5, F.col("car"))).alias("disagreement"))


MST = """mb AS (SELECT * FROM feat WHERE ret IS NOT NULL AND vol_chg IS NOT NULL AND volatility IS NOT NULL AND mkt_ret IS NOT NULL AND ma5_gap IS NOT NULL AND ma20_gap IS NOT NULL),
  st AS (SELECT industry_code, d, sum(ret) OVER n AS sg, greatest((stddev_pop(ret) OVER f + 1e-8) * 5, 0.01) AS dn FROM mb WINDOW n AS (PARTITION BY industry_code ORDER BY d ROWS 19 PRECEDING), f AS (PARTITION BY industry_code ORDER BY d ROWS 119 PRECEDING))"""


@query("e23_momentum_prob", f"WITH {MST}, " + asof_sql("st", "r6(coalesce(1 / (1 + exp(-3 * sg / dn)), 0.5)) AS momentum_prob, r6(coalesce(1 / (1 + exp(-3 * sg / 0.4)), 0.5)) AS fixed_prob"))
def _(s):
    m = S.momentum_prob(s.scn, s.feat).select("event_id", "industry_code", "event_date", "momentum_prob")
    return S.momentum_prob(m.withColumnRenamed("momentum_prob", "a"), s.feat, scale=0.4).select(
        "event_id", "industry_code", r6("a").alias("momentum_prob"), r6("momentum_prob").alias("fixed_prob"))


def vectors(s):
    """Fusion inputs per scenario; features come once per (industry, date)."""
    keys = s.scn.select("industry_code", "event_date").distinct()
    f = X.froth(X.valuation_snapshot(S.momentum_prob(keys, s.feat), s.val), s.margin)
    base = s.res(0).join(f, ["industry_code", "event_date"]).withColumns({
        "ts_prob_up": F.col("momentum_prob"), "ts_signal": F.col("car"), "irf_prior": (F.ascii("industry_code") % 3 - 1) * 0.5,
        "text_net": F.col("prob_up") - 0.5, "text_bull_bear": F.col("prob_up") * 2 - 1,
        "disagreement": S.disagreement(F.col("prob_up") - 0.5, F.col("car"))})
    return S.fusion_vector(base)


VEC = f"""{MST.replace('st AS', 'ms AS')}, {VSTATE.replace('st AS', 'vs AS').replace('n AS (', 'vn AS (').replace('FROM n a JOIN n b', 'FROM vn a JOIN vn b')}, {FSTATE.replace('st AS', 'fs AS').replace('m AS (', 'fm AS (', 1).replace('FROM m a JOIN m b', 'FROM fm a JOIN fm b')},
  km AS (SELECT industry_code, event_date, max(d) AS d FROM probe JOIN ms USING (industry_code) WHERE d < event_date GROUP BY 1, 2), kv AS (SELECT industry_code, event_date, max(d) AS d FROM probe JOIN vs USING (industry_code) WHERE d < event_date GROUP BY 1, 2),
  kf AS (SELECT event_date, max(d) AS d FROM (SELECT DISTINCT event_date FROM ev) JOIN fs ON d < event_date GROUP BY 1),
  vec AS (SELECT r.event_id, r.industry_code, r.event_type, r.event_date, r.real_dir, coalesce(1 / (1 + exp(-3 * sg / dn)), 0.5) AS tp, coalesce(CASE WHEN vs.n_hist >= 60 THEN -(pe_p - 0.5) * 2 END, 0) AS va, coalesce(CASE WHEN fs.k >= 50 AND h >= 20 THEN 2 * p - 1 END, 0) AS fr,
    CAST(ascii(r.industry_code) % 3 - 1 AS INT) * 0.5::DOUBLE AS ir, prob_up * 2 - 1 AS bb, least(1, greatest(0, abs({tanh_sql('(prob_up - 0.5)')} - {tanh_sql('car * 5')}))) AS dg
   FROM res0 r LEFT JOIN km USING (industry_code, event_date) LEFT JOIN ms ON ms.industry_code = r.industry_code AND ms.d = km.d LEFT JOIN kv ON kv.industry_code = r.industry_code AND kv.event_date = r.event_date
   LEFT JOIN vs ON vs.industry_code = r.industry_code AND vs.d = kv.d LEFT JOIN kf ON kf.event_date = r.event_date LEFT JOIN fs ON fs.d = kf.d)"""
RAW = f"0.55::DOUBLE * tp + 0.1::DOUBLE * {tanh_sql('va')} + 0.1::DOUBLE * {tanh_sql('fr')} + 0.1::DOUBLE * {tanh_sql('ir')}"


@query("e24_fusion_vector", f"WITH {VEC} SELECT event_id, industry_code, r6(tp) AS ts_prob_up, r6(va) AS valuation_signal, r6(fr) AS froth, r6(ir) AS irf_prior, r6(dg) AS disagreement FROM vec")
def _(s):
    return vectors(s).select("event_id", "industry_code", *[r6(c).alias(c) for c in ("ts_prob_up", "valuation_signal", "froth", "irf_prior", "disagreement")])


@query("e25_raw_score", f"WITH {VEC} SELECT event_id, industry_code, r6(least(1, greatest(0, {RAW}))) AS evaluator, r6(least(1, greatest(0, {RAW} + 0.15::DOUBLE * {tanh_sql('bb / 1.5')} - 0.15::DOUBLE * dg))) AS fusion FROM vec")
def _(s):
    return vectors(s).select("event_id", "industry_code", r6(S.raw_score()).alias("evaluator"), r6(S.raw_score("fusion")).alias("fusion"))


@query("e26_shrink_signal", "SELECT event_id, industry_code, r6((prob_up - 0.5) * 0.65) AS neutral, r6((prob_up - 0.5) * 0.65) AS fixed, r6(0) AS zero FROM res0")
def _(s):
    n = F.col("prob_up") - 0.5
    return s.res(0).select("event_id", "industry_code", *[r6(S.shrink_signal(n, m)).alias(m) for m in ("neutral", "fixed", "zero")])


@query("e27_correct_path", """WITH sg AS (SELECT industry_code, d, (day(d) % 11 - 5) / 2.0::DOUBLE AS net, CASE WHEN industry_code = 'SMALL' THEN 0.5::DOUBLE ELSE 1 END AS sens FROM (SELECT DISTINCT industry_code, d FROM fc)),
  a AS (SELECT *, net * sens AS adj, least(0.8, greatest(-0.8, net * sens * 0.2)) AS c FROM sg), b AS (SELECT industry_code, d, step, adj, c, greatest(0.55, 1 - 0.035 * step) AS dec, mean + c * greatest(0.55, 1 - 0.035 * step) AS y FROM fc JOIN a USING (industry_code, d)),
  m AS (SELECT industry_code, d, avg(y) AS m5 FROM b WHERE step < 5 GROUP BY 1, 2)
  SELECT industry_code, d, step, r6(c) AS correction, r6(y + CASE WHEN abs(adj) > 0.3 AND (m5 > 0) <> (adj > 0) THEN least(0.03, greatest(-0.03, sign(adj) * (abs(m5) + abs(adj) * 0.005))) ELSE 0 END * dec) AS corrected FROM b JOIN m USING (industry_code, d)""")
def _(s):
    sig = s.fc.select("industry_code", "d").distinct().withColumns({"net_signal": (F.dayofmonth("d") % 11 - 5) / 2.0, "sensitivity": F.when(F.col("industry_code") == "SMALL", 0.5).otherwise(1.0)})
    c = S.correct_path(s.fc, sig, ["industry_code", "d"], scale=0.2, cap=0.8)
    return c.select("industry_code", "d", "step", r6("correction").alias("correction"), r6("corrected").alias("corrected"))


@query("e28_inject_ramp", """WITH x AS (SELECT industry_code, d, step, (day(d) % 11 - 5) / 2.0::DOUBLE AS net FROM fc)
  SELECT industry_code, d, step, r6(CASE WHEN step >= 4 THEN least(2, greatest(-2, net * (step - 3) / 6.0::DOUBLE)) ELSE 0 END) AS net_ramp FROM x""")
def _(s):
    x = s.fc.select("industry_code", "d", "step", ((F.dayofmonth("d") % 11 - 5) / 2.0).alias("net"))
    return S.inject_ramp(x, ["industry_code", "d"], "net", "net", 6, "step").select("industry_code", "d", "step", r6("net_ramp").alias("net_ramp"))
