"""Graph queries (K rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.functions.cols import r6
from evq.operators import graph as G
from evq.plans.catalog import query

AS_OF = "2001-06-30"
EW = f"(CASE WHEN ttl_days IS NULL THEN weight * confidence ELSE weight * confidence * power(2.0::DOUBLE, -greatest(DATE '{AS_OF}' - created_at, 0) / ttl_days) END)"


def as_of():
    return F.lit(AS_OF).cast("date")


@query("k1_kg_from_events", """SELECT DISTINCT 'event_' || CAST(event_date AS VARCHAR) || '_' || event_type AS src, 'industry_' || industry_code AS dst, 'affects' AS relation, 0.8::DOUBLE AS weight, 60.0::DOUBLE AS ttl_days FROM scn""")
def _(s):
    return G.kg_from_events(s.scn)[1].select("src", "dst", "relation", "weight", "ttl_days")


@query("k2_effective_weight", f"SELECT src, dst, r6({EW}) AS w, r6(CASE WHEN ttl_days IS NULL THEN weight ELSE {EW} END) AS w_legacy FROM kg_edges")
def _(s):
    return s.kg_edges.select("src", "dst", r6(G.effective_weight(as_of())).alias("w"), r6(G.effective_weight(as_of(), True)).alias("w_legacy"))


SUB = f"""WITH RECURSIVE lk AS (SELECT src AS a, dst AS b FROM kg_edges WHERE {EW} >= 0.05 UNION SELECT dst, src FROM kg_edges WHERE {EW} >= 0.05),
  r(node, hop) AS (SELECT node, 0 FROM kg_nodes WHERE contains(name, 'EUROPE') OR contains(name, 'Supplier#000000001') UNION SELECT b, hop + 1 FROM r JOIN lk ON a = node WHERE hop < 3),
  sn AS (SELECT node, CAST(min(hop) AS INT) AS hop FROM r GROUP BY 1)"""


def sub(s):
    return G.subgraph(s.kg_edges, G.seeds_by_name(s.kg_nodes, ["EUROPE", "Supplier#000000001"]), 3, as_of())


@query("k3_subgraph_nodes", SUB + " SELECT node, hop FROM sn")
def _(s):
    return sub(s)


@query("k3_subgraph_edges", SUB + f" SELECT src, dst, r6({EW}) AS w FROM kg_edges WHERE {EW} >= 0.05 AND src IN (SELECT node FROM sn) AND dst IN (SELECT node FROM sn)")
def _(s):
    return G.induced_edges(s.kg_edges, sub(s), as_of()).select("src", "dst", r6("w").alias("w"))


@query("k4_propagate", f"""WITH RECURSIVE e AS (SELECT src, dst, {EW} AS w FROM kg_edges), p(node, strength, level) AS (SELECT 's:3', 1.0::DOUBLE, 0 UNION SELECT dst, strength * w, level + 1 FROM p JOIN e ON src = node WHERE strength * w >= 0.05)
  SELECT node, r6(max(strength)) AS strength, CAST(min(level) AS INT) AS level FROM p GROUP BY 1""")
def _(s):
    p = G.propagate(s.kg_nodes, s.kg_edges, s.kg_nodes.filter("node = 's:3'"), as_of())
    return p.select("node", r6("strength").alias("strength"), "level")


@query("k5_update_edges", f"""WITH d AS (SELECT 'c:' || l_suppkey AS src, 'a:' || l_partkey AS dst, sum(l_discount - 0.05) AS dl FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
  SELECT src, dst, relation, r6(CASE WHEN dl IS NULL THEN weight ELSE least(2, greatest(0, weight + dl)) END) AS weight, CASE WHEN dl IS NULL THEN created_at ELSE DATE '{AS_OF}' END AS created_at FROM kg_edges LEFT JOIN d USING (src, dst)""")
def _(s):
    d = s.t("lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("c:"), "l_suppkey").alias("src"), F.concat(F.lit("a:"), "l_partkey").alias("dst"),
                                                            F.lit("supplies").alias("relation"), (F.col("l_discount") - 0.05).alias("delta"))
    return G.update_edges(s.kg_edges, d, as_of()).select("src", "dst", "relation", r6("weight").alias("weight"), "created_at")


CE = """ce AS (SELECT 'u' || user_id AS source, event_type AS target, 'affects' AS relation, CAST(ts AS DATE) AS time, event_id AS seq, (CAST(json_extract_string(props, '$.k') AS INT) + 1) / 100.0::DOUBLE AS weight,
  least(1.0::DOUBLE, value / 40) AS confidence, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS n_ev FROM events)"""


def causal(s):
    return s.t("events").select(
        F.concat(F.lit("u"), "user_id").alias("source"), F.col("event_type").alias("target"), F.lit("affects").alias("relation"), F.to_date("ts").alias("time"), F.col("event_id").alias("seq"),
        ((F.get_json_object("props", "$.k").cast("int") + 1) / 100.0).alias("weight"), F.least(F.lit(1.0), F.col("value") / 40).alias("confidence"),
        F.when(F.col("event_type") == "error", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("e"), "event_id"))).alias("evidence_ids"))


@query("k6_upsert_edges", f"WITH {CE} SELECT source, target, time, seq, r6(weight) AS weight FROM ce QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY time DESC, seq DESC) = 1")
def _(s):
    return G.upsert_edges(causal(s)).select("source", "target", "time", "seq", r6("weight").alias("weight"))


@query("k7_rule_edges", """SELECT doc_id, 'event' AS source, target, r6(w) AS weight FROM (SELECT doc_id, 'bank' AS target, 0.8 AS w FROM docs WHERE contains(text, 'there') OR contains(text, 'eaux')
  UNION ALL SELECT doc_id, unnest(CASE WHEN lang = 'en' THEN ['SMALL', 'LARGE'] WHEN lang = 'fr' THEN ['PROMO'] ELSE ['market'] END), 0.7 FROM docs)""")
def _(s):
    codes = F.when(F.col("lang") == "en", F.array(F.lit("SMALL"), F.lit("LARGE"))).when(F.col("lang") == "fr", F.array(F.lit("PROMO"))).otherwise(F.array().cast("array<string>"))
    e = G.rule_edges(s.docs.select("doc_id", "text", codes.alias("industries")), ["there", "eaux"])
    return e.select("doc_id", "source", "target", r6("weight").alias("weight"))


@query("k8_validate_edges", f"""WITH {CE} SELECT seq, r6(CASE WHEN target = 'click' THEN confidence WHEN seq % 3 = 0 THEN confidence * 0.3 ELSE least(1, confidence * (seq % 10) / 10.0::DOUBLE) END) AS confidence FROM ce""")
def _(s):
    e = causal(s)
    v = e.filter("target <> 'click'").select("seq", (F.col("seq") % 3 != 0).alias("valid"), ((F.col("seq") % 10) / 10.0).alias("confidence"))
    return G.validate_edges(e, v, ["seq"]).select("seq", r6("confidence").alias("confidence"))


RANK = """WITH RECURSIVE e AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, sum(weight) AS w FROM kg_edges WHERE weight > 0 GROUP BY 1, 2)),
  n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), v AS (SELECT node, {start} AS v FROM n),
  f(node, m, h) AS (SELECT node, v, 0 FROM v WHERE v > 0 UNION ALL SELECT dst, sum(0.85::DOUBLE * m * p), h + 1 FROM f JOIN e ON src = node GROUP BY dst, h), y AS (SELECT node, sum(m) AS y FROM f GROUP BY 1)
  SELECT node, r6(1000 * coalesce(y, 0) / (SELECT sum(y) FROM y)) AS rank_k FROM n LEFT JOIN y USING (node)"""


@query("k9_pagerank", RANK.format(start="1.0::DOUBLE / (SELECT count(*) FROM n)"))
def _(s):
    e = s.kg_edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")
    return G.pagerank(e).select("node", r6(F.col("rank") * 1000).alias("rank_k"))


@query("k9_pagerank_personalised", RANK.format(start="CASE node WHEN 's:1' THEN 0.75::DOUBLE WHEN 's:2' THEN 0.25::DOUBLE ELSE 0 END"))
def _(s):
    e = s.kg_edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")
    start = s.kg_nodes.filter("node in ('s:1', 's:2')").select("node", F.when(F.col("node") == "s:1", 3.0).otherwise(1.0).alias("value"))
    return G.pagerank(e, start).select("node", r6(F.col("rank") * 1000).alias("rank_k"))


@query("k9_pagerank_decayed")
def _(s):
    t = F.lit("2024-02-01").cast("date")
    e = G.upsert_edges(causal(s)).select("source", "target", G.temporal_weight(t).alias("weight"))
    return G.pagerank(e, tol=1e-9).select("node", r6(F.col("rank") * 1000).alias("rank_k"))


@query("k10_causal_paths", """WITH RECURSIVE e AS (SELECT src, dst, relation, weight * confidence AS w, greatest(1e-6, 1 - least(weight * confidence, 0.999)) AS c, confidence AS f, 'd' || length(src) || length(dst) AS v FROM kg_edges),
  p(nodes, node, cost, conf, h, edges, ev) AS (SELECT 's:1', 's:1', 0.0::DOUBLE, 1.0::DOUBLE, 0, '', []::VARCHAR[]
    UNION ALL SELECT nodes || '>' || dst, dst, cost + c, conf * f, h + 1, edges || CASE WHEN h > 0 THEN ',' ELSE '' END || src || '-' || relation || '-' || dst || '-' || CAST(round(w * 1000) AS INT), list_append(list_append(ev, v), dst)
    FROM p JOIN e ON src = node WHERE node <> 'a:7' AND NOT list_contains(string_split(nodes, '>'), dst))
  SELECT CAST(row_number() OVER (ORDER BY round(cost, 9), nodes) AS INT) AS rank, nodes, r6(cost) AS cost, r6(conf) AS confidence, h AS hops, edges, array_to_string(list_sort(list_distinct(ev)), ',') AS evidence_ids FROM p WHERE node = 'a:7' QUALIFY rank <= 5""")
def _(s):
    evidence = F.array(F.concat(F.lit("d"), F.length("src"), F.length("dst")), "dst")
    e = s.kg_edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", (F.col("weight") * F.col("confidence")).alias("w"), "confidence", evidence.alias("evidence_ids"))
    p = G.causal_paths(e, "s:1", "a:7", 5)
    told = F.transform("edges", lambda x: F.concat_ws("-", x["source"], x["relation"], x["target"], F.round(x["weight"] * 1000).cast("int")))
    return p.select("rank", F.concat_ws(">", "nodes").alias("nodes"), r6("cost").alias("cost"), r6("confidence").alias("confidence"), "hops", F.array_join(told, ",").alias("edges"), F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query("k11_graph_quality", f"WITH {CE}, u AS (SELECT * FROM ce QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY time DESC, seq DESC) = 1) SELECT count(*) AS edge_count, r6(avg(n_ev)) AS evidence_coverage, r6(avg(confidence)) AS avg_confidence, false AS has_cycle FROM u")
def _(s):
    q = G.graph_quality(G.upsert_edges(causal(s)))
    return q.select("edge_count", r6("evidence_coverage").alias("evidence_coverage"), r6("avg_confidence").alias("avg_confidence"), "has_cycle")


@query("k12_compare_edges", f"""WITH {CE}, a AS (SELECT DISTINCT source, target FROM ce WHERE weight > 0.5), b AS (SELECT DISTINCT source, target FROM ce WHERE confidence > 0.5),
  t AS (SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS tp, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS fp, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS fn)
  SELECT tp, fp, fn, r6(tp / CAST(tp + fp AS DOUBLE)) AS precision, r6(tp / CAST(tp + fn AS DOUBLE)) AS recall, r6(2.0 * tp / (2 * tp + fp + fn)) AS f1 FROM t""")
def _(s):
    e = causal(s)
    c = G.compare_edges(e.filter("weight > 0.5"), e.filter("confidence > 0.5"))
    return c.select("tp", "fp", "fn", *[r6(x).alias(x) for x in ("precision", "recall", "f1")])


def timeline(s):
    """One entry per event row: its own causal edge, then the edge from capital flow."""
    e = causal(s)

    def path(source, target, relation):
        return F.struct(source.alias("source"), target.alias("target"), relation.alias("relation"), F.col("weight").alias("weight"), F.col("evidence_ids").alias("evidence_ids"))

    return e.select("seq", F.col("time").alias("date"), F.array(path(F.col("source"), F.col("target"), F.col("relation")),
                                                                 path(F.lit("capital_flow"), F.col("source"), F.lit("causes"))).alias("causal_paths"))


TL = """tl AS (SELECT seq, time, source, target, relation, weight, 0 AS i FROM ce UNION ALL SELECT seq, time, 'capital_flow', source, 'causes', weight, 1 FROM ce)"""


@query("k13_flip_first_edge", f"WITH {CE}, {TL} SELECT seq, source, target, CASE WHEN i = 0 THEN 'contradicts' ELSE relation END AS relation FROM tl")
def _(s):
    p = G.flip_first_edge(timeline(s), "causal_paths").select("seq", F.explode("causal_paths").alias("e"))
    return p.select("seq", "e.source", "e.target", "e.relation")


@query("k14_edges_from_timeline", f"WITH {CE}, {TL} SELECT source, target, relation, time, r6(weight) AS weight, 0.7::DOUBLE AS confidence FROM tl")
def _(s):
    return G.edges_from_timeline(timeline(s)).select("source", "target", "relation", "time", r6("weight").alias("weight"), "confidence")
