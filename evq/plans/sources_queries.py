"""Source and sink queries (A rows), over tables Spark derives from the given ones."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evq.functions.cols import r6
from evq.functions.lineage import shared_folder
from evq.operators.graph import upsert_edges
from evq.plans.catalog import query
from evq.plans.graph_queries import CE, causal
from evq.sources import readers as R
from evq.sources import sinks as W


def folder(s, name):
    return f"{shared_folder(s.spark)}/{name}-{uuid.uuid4().hex[:8]}"


@query("a1_read_panel", "SELECT industry_code, d, r6(close) AS close, volume FROM px")
def _(s):
    raw = s.px.select("industry_code", F.lit("x").alias("industry_name"), F.col("d").cast("string").alias("trade_date"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], "volume", F.col("volume").alias("amount"))
    path = folder(s, "panel")
    W.write_table(raw, path, "csv")
    return R.read_panel(s.spark, path).select("industry_code", "d", r6("close").alias("close"), "volume")


@query("a2_normalize_columns", "SELECT d, r6(mkt_close) AS close FROM mkt")
def _(s):
    raw = s.mkt.select(F.col("d").cast("string").alias("Trade_Date"), F.col("mkt_close").alias("收盘价"))
    return R.normalize_columns(raw).select("d", r6("close").alias("close"))


@query("a3_read_optional", "SELECT d AS date, industry_code, r6(pe_ttm) AS pe_ttm FROM val")
def _(s):
    path = folder(s, "valuation")
    W.write_table(s.val.select(F.col("d").alias("date"), "industry_code", "pe_ttm", "pb", "dividend_yield"), path)
    missing = R.read_optional(s.spark, path + "-absent", R.VALUATION)
    return R.read_optional(s.spark, path, R.VALUATION, "parquet").unionByName(missing).select("date", "industry_code", r6("pe_ttm").alias("pe_ttm"))


@query("a4_read_events", """WITH l AS (SELECT event_id, event_date, event_type, string_agg(industry_code, '|' ORDER BY industry_code) AS industries, count(*) AS k FROM scn GROUP BY ALL)
  SELECT event_id, event_date, event_type, industries, CAST(k AS INT) AS n FROM l""")
def _(s):
    raw = s.scn.groupBy("event_id", "event_date", "event_type").agg(F.array_join(F.sort_array(F.collect_list("industry_code")), "， ").alias("affected_industries")).withColumn("event_date", F.col("event_date").cast("string"))
    e = R.typed_events(raw)
    return e.select("event_id", "event_date", "event_type", F.array_join("affected_industries", "|").alias("industries"), F.size("affected_industries").alias("n"))


@query("a5_read_documents", "SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source, pub_date, length(text) AS n, coalesce(CAST(pub_date AS TIMESTAMP), TIMESTAMP '1970-01-01') AS pub_time, doc_type FROM docs")
def _(s):
    raw = s.docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("event_date"), F.lit("t").alias("event_tag"), "doc_type", "source",
                        F.coalesce(F.col("pub_date").cast("string"), F.lit("unknown")).alias("pub_date"), "text")
    path = folder(s, "documents")
    W.write_table(raw, path, "json")
    d = R.read_documents(s.spark, path)
    return d.select("chunk_id", "source", "pub_date", F.length("text").alias("n"), "pub_time", F.col("metadata")["doc_type"].alias("doc_type"))


@query("a6_read_priors", """SELECT p_brand AS event_type, p_type AS industry_code, CAST(min(p_size) % 3 - 1 AS INT) AS direction, r6(avg(p_size) / 100) AS strength, r6((min(p_size) % 3 - 1) * (avg(p_size) / 100)) AS signed_strength FROM part GROUP BY 1, 2""")
def _(s):
    cell = s.t("part").groupBy("p_brand", "p_type").agg((F.min("p_size") % 3 - 1).alias("direction"), (F.avg("p_size") / 100).alias("strength"))
    js = cell.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("p_type", F.struct("direction", "strength")))).alias("m"))
    raw = js.select(F.to_json(F.create_map("p_brand", "m")).alias("priors"))
    return R.flat_priors(raw).select("event_type", "industry_code", "direction", r6("strength").alias("strength"), r6("signed_strength").alias("signed_strength"))


@query("a7_read_results", "SELECT event_id, CAST(horizon AS INT) AS horizon, r6(CASE WHEN horizon = 5 THEN v END) AS risk FROM (SELECT event_id, horizon, max(pred_var) AS v FROM rr0 GROUP BY 1, 2)")
def _(s):
    rr = s.risk_rows().groupBy("event_id", "horizon").agg(F.max("pred_var").alias("v"))
    base, paths = folder(s, "results"), []
    for h, name in ((1, "event_VaR_T1"), (5, "event_VaR_T5"), (20, "event_CVaR")):
        paths.append(f"{base}/{h}")
        rr.filter(F.col("horizon") == h).withColumnRenamed("v", name).write.option("header", True).csv(paths[-1])
    u = R.read_results(s.spark, paths)
    return u.select(F.col("event_id").cast("long").alias("event_id"), F.col("horizon").cast("int").alias("horizon"), r6(R.pred_col(u, "event_VaR", 5)).alias("risk"))


@query("a8_latest_runs", """WITH r AS (SELECT o_orderpriority AS tag, o_orderstatus || year(o_orderdate) AS run, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2) SELECT tag, run, n FROM r WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY tag ORDER BY run DESC) = 1""")
def _(s):
    rows = s.t("orders").select(F.col("o_orderpriority").alias("tag"), F.concat("o_orderstatus", F.year("o_orderdate").cast("string")).alias("run"))
    return R.latest_runs(rows, 20, exclude="^P")


@query("a9_pending", "SELECT event_id, industry_code FROM scn EXCEPT SELECT event_id, industry_code FROM res0 WHERE NOT abstain")
def _(s):
    keys = ["event_id", "industry_code"]
    return R.pending(s.scn.select(*keys), s.res(0).filter("not abstain"), keys)


@query("a10_merge_years", """SELECT d AS date, industry_code, industry_code || '!' AS industry_name, r6(pe_ttm) AS pe_ttm FROM val WHERE industry_code IN ('SMALL', 'LARGE')""")
def _(s):
    v = s.val.select(F.col("d").alias("day"), "industry_code", "pe_ttm", "pb")
    parts = [v.filter(F.year("day") <= 1998), v.filter(F.year("day") >= 1998)]
    return R.merge_years(parts, {"SMALL": "SMALL!", "LARGE": "LARGE!"}, {"day": "date"}).select("date", "industry_code", "industry_name", r6("pe_ttm").alias("pe_ttm"))


@query("a11_margin_total", """WITH b AS (SELECT d, total_fin / 2 AS z FROM margin WHERE day(d) > 10), j AS (SELECT m.d, total_fin, last_value(z IGNORE NULLS) OVER (ORDER BY m.d) AS z FROM margin m LEFT JOIN b USING (d))
  SELECT d AS date, r6(z) AS szse_fin, r6(total_fin + coalesce(z, 0)) AS total_fin FROM j""")
def _(s):
    a = s.margin.select(F.col("d").alias("date"), F.col("total_fin").alias("sse_fin"))
    b = s.margin.filter(F.dayofmonth("d") > 10).select(F.col("d").alias("date"), (F.col("total_fin") / 2).alias("szse_fin"))
    return R.margin_total(a, b).select("date", r6("szse_fin").alias("szse_fin"), r6("total_fin").alias("total_fin"))


@query("a12_write_table", "SELECT event_id, industry_code, CAST(horizon AS INT) AS horizon, realized_car, realized_mdd FROM rr0")
def _(s):
    long = s.risk_rows()
    wide = long.groupBy("event_id", "industry_code").agg(*[F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{c}_T{h}") for c in ("realized_car", "realized_mdd") for h in (1, 5, 20)])
    rows = W.per_horizon(wide, {"realized_car": "realized_car", "realized_mdd": "realized_mdd"}, (1, 5, 20)).filter("realized_car is not null")
    path = folder(s, "results")
    W.write_table(rows, path, partition_by=["horizon"])
    return s.spark.read.parquet(path).select("event_id", "industry_code", "horizon", "realized_car", "realized_mdd")


@query("a13_edge_snapshot", f"WITH {CE} SELECT source, target, seq, r6(confidence) AS confidence FROM ce QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY time DESC, seq DESC) = 1")
def _(s):
    base = folder(s, "edges")
    e = upsert_edges(causal(s))
    W.save_edges(e.limit(0), base, "2024-02-01")
    W.save_edges(e, base, "2024-02-01")
    return W.load_edges(s.spark, base, "2024-02-01").select("source", "target", "seq", r6("confidence").alias("confidence"))


@query("a14_read_responses", "SELECT conv_id || '/' || turn AS response_id, text AS content FROM conversations")
def _(s):
    one = F.to_json(F.create_map(F.concat_ws("/", "conv_id", "turn"), F.struct(F.col("text").alias("content"))))
    return R.response_lines(s.t("conversations").select(one.alias("value"))).select("response_id", "content")


@query("a15_dedupe", "SELECT event_date, industry_code, min(event_id) AS event_id, arg_min(prob_up, event_id) AS prob_up FROM res0 GROUP BY 1, 2")
def _(s):
    return R.dedupe(s.res(0).select("event_date", "industry_code", "event_id", "prob_up"), ["event_date", "industry_code"], ["event_id"])
