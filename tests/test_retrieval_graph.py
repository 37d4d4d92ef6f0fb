"""Retrieval, graph, ticks, streaming, readers and the query registry."""

import datetime as dt
import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evq.operators import graph as G
from evq.operators import retrieval as J
from evq.operators import signals as S
from evq.operators import ticks as K
from evq.sources import readers as R
from evq.sources import sinks as W
from evq.streaming import runs

D = dt.date


def test_vector_topk_blocks_match_brute_force(spark):
    rng = np.random.default_rng(1)
    d, q = rng.normal(size=(300, 8)), rng.normal(size=(25, 8))
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(d)], "doc_id long, vec array<double>").repartition(5)
    qs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, vec array<double>")
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T
    for cap in (4096, 6):
        got = J.vector_topk(qs, docs, 7, max_queries=cap).toPandas()
        for i in range(25):
            assert got[got["query_id"] == i].sort_values("rank")["doc_id"].tolist() == np.argsort(-s[i])[:7].tolist()


def test_bm25_sees_only_the_past(spark):
    docs = spark.createDataFrame([(1, "rate cut bank", D(2020, 1, 1), None), (2, "rate cut cut", D(2020, 2, 1), None), (3, "other words", None, None), (4, "bank words", D(2020, 1, 5), None)],
                                 "doc_id long, text string, pub_date date, valid_from date")
    q = spark.createDataFrame([(1, "rate cut", D(2020, 1, 15)), (2, "rate cut", D(2020, 3, 1))], "query_id long, text string, as_of date")
    got = {(r.query_id, r.doc_id): r.score for r in J.bm25_topk(q, docs, 5).collect()}
    assert set(got) == {(1, 1), (2, 1), (2, 2)}
    idf = np.log((2 - 1 + 0.5) / 1.5 + 1)
    assert abs(got[(1, 1)] - 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / 2.5))) < 1e-8


def test_future_documents_change_no_hit(spark):
    """Cutting the corpus at the query's date leaves TF-IDF and hybrid hits as they are; small query blocks too."""
    rng = np.random.default_rng(9)
    words = ["rate", "cut", "bank", "oil", "war", "tax", "chip", "rice"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(2, 12))), D(2020, 1, 1) + dt.timedelta(days=int(rng.integers(0, 60))), None) for i in range(80)]
    kinds = "doc_id long, text string, pub_date date, valid_from date"
    q = spark.createDataFrame([(1, "rate cut war", D(2020, 1, 20)), (2, "bank oil", D(2020, 2, 10))], "query_id long, text string, as_of date")
    whole = spark.createDataFrame(rows, kinds)
    for run in (lambda a, d: J.tfidf_topk(a, d, 6, n_terms=4), lambda a, d: J.tfidf_topk(a, d, 6, n_terms=4, max_queries=1), lambda a, d: J.retrieve(a, d, 5)):
        for i, day in ((1, D(2020, 1, 20)), (2, D(2020, 2, 10))):
            one = q.filter(F.col("query_id") == i)
            past = spark.createDataFrame([r for r in rows if r[2] < day], kinds)
            key = lambda d: sorted((r.rank, r.doc_id, round(r.score, 9)) for r in d.collect())
            assert key(run(q, whole).filter(F.col("query_id") == i)) == key(run(one, past))


def _pagerank(edges, n, pers=None):
    m = np.zeros((n, n))
    for a, b, w in edges:
        m[a, b] += w
    out = m.sum(1)
    v = np.full(n, 1 / n) if pers is None else pers / pers.sum()
    x = np.full(n, 1 / n)
    for _ in range(500):
        p = np.divide(m, out[:, None], where=out[:, None] > 0, out=np.zeros_like(m))
        x = 0.85 * (x @ p + x[out == 0].sum() * v) + 0.15 * v
    return x


@pytest.mark.parametrize("personal", [False, True])
def test_pagerank_matches_power_iteration(spark, personal):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 8, 25), rng.integers(0, 12, 25), rng.random(25) + 0.1)]
    nodes = sorted({x for e in edges for x in e[:2]})
    ix = {k: i for i, k in enumerate(nodes)}
    pers = np.array([1.0 if i < 3 else 0.0 for i in range(len(nodes))]) if personal else None
    want = _pagerank([(ix[a], ix[b], w) for a, b, w in edges], len(nodes), pers)
    df = spark.createDataFrame([(str(a), str(b), w) for a, b, w in edges], "source string, target string, weight double")
    p = spark.createDataFrame([(str(nodes[i]), 1.0) for i in range(3)], "node string, value double") if personal else None
    got = {r.node: r.rank for r in G.pagerank(df, p, tol=1e-9).collect()}
    assert all(abs(got[str(k)] - want[ix[k]]) < 1e-6 for k in nodes) and abs(sum(got.values()) - 1) < 1e-9


def test_causal_path_and_cycle(spark):
    e = spark.createDataFrame([("event", "bank", 0.81, 0.9), ("bank", "market", 0.64, 0.8), ("event", "x", 0.1, 0.1)], "source string, target string, w double, confidence double")
    p = G.causal_paths(e, "event", "market", 3).collect()
    assert len(p) == 1 and p[0].nodes == ["event", "bank", "market"] and abs(p[0].confidence - 0.72) < 1e-9
    assert not G.has_cycle(e) and G.has_cycle(e.unionByName(spark.createDataFrame([("market", "event", 1.0, 1.0)], e.schema)))


def test_propagation_stops_and_never_descends(spark):
    nodes = spark.createDataFrame([("s", 0), ("i", 1), ("c", 2), ("far", 3)], "node string, rank int")
    e = spark.createDataFrame([("s", "i", 0.5), ("i", "c", 0.5), ("c", "far", 0.1), ("i", "s", 1.0)], "src string, dst string, weight double").withColumns(
        {"confidence": F.lit(1.0), "ttl_days": F.lit(None).cast("double"), "created_at": F.lit(None).cast("date")})
    got = {r.node: r.strength for r in G.propagate(nodes, e, nodes.filter("node = 's'"), F.lit("2024-01-01").cast("date")).collect()}
    assert got == {"s": 1.0, "i": 0.5, "c": 0.25}


def test_factor_parity(spark):
    steps = [dict(step=1, entity="a", impact_direction="+", impact_magnitude="高", confidence=0.5), dict(step=2, entity="a", impact_direction="?", impact_magnitude="中", confidence=0.4),
             dict(step=3, entity="b", impact_direction="", impact_magnitude="低", confidence=1.0), dict(step=4, entity="c", impact_direction="+", impact_magnitude="?", confidence=1.0)]
    resp = spark.createDataFrame([("r", "text " + json.dumps({"chain": steps}, ensure_ascii=False))], "response_id string, content string")
    got = {r.entity: r.factor for r in S.factors_from_chain(S.parse_chain(resp)).collect()}
    assert abs(got["a"] + 0.2) < 1e-12 and abs(got["b"] + 0.2) < 1e-12 and got["c"] == 0.0


def test_default_word_lists(spark):
    df = spark.createDataFrame([("央行降准并宽松",), ("加征关税，市场暴跌，风险",), ("无",)], "text string")
    t = F.col("text")
    assert [r[0] for r in df.select(S.text_direction(t)).collect()] == ["+", "-", "?"]
    f = S.text_factors(df).collect()
    assert {r.name for r in f} == {"text_positive", "text_negative"} and max(r.value for r in f) == 0.9
    s = spark.createDataFrame([("结论：+",), ("下跌",), ("positive view",), ("no",)], "text string")
    assert [r[0] for r in s.select(S.parse_direction(t)).collect()] == ["+", "-", "+", "+"]


def test_shock_reasons(spark):
    t = spark.createDataFrame([(D(2024, 1, 1), -0.03, {"801": -0.05, "802": 0.01}, -0.02), (D(2024, 1, 2), 0.0, {"801": 0.01}, 0.0)],
                              "date date, market_return double, industry_returns map<string,double>, margin_change double")
    got = [r.triggered_event for r in K.detect_shocks(t).orderBy("date").collect()]
    assert got == ["market_move=-0.0300 | industry_move=801:-0.0500", None]
    assert K.tick_edges(K.detect_shocks(t)).count() == 2 + 2 + 1 + 2 + 1


def test_stream_equals_batch_across_files(spark, tmp_path):
    rng = np.random.default_rng(10)
    rows = [("k" if i % 3 else "j", i, float(rng.normal()), bool(rng.random() < 0.6)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, seq long, residual double, in_interval boolean")
    for n in range(3):
        df.filter((F.col("seq") >= 40 * n) & (F.col("seq") < 40 * n + 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = runs.file_stream(spark, str(tmp_path / "in"), df.schema, "*.parquet", 1)
    got = {(r.k, r.seq): r.reason for r in runs.residual_monitor_stream(src, "k", 1.0).collect()}
    want = {(r.k, r.seq): r.reason for r in K.residual_monitor(df, ["k"], ["seq"], 1.0).collect()}
    assert got == want and "coverage" in got.values() and "residual" in got.values()


def test_late_rows_are_dropped(spark, tmp_path):
    def put(n, rows):
        spark.createDataFrame(rows, "ts timestamp, industry_code string, value double").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))

    t0 = dt.datetime(2024, 1, 1)
    put(0, [(t0, "a", 1.0), (t0 + dt.timedelta(hours=5), "a", 2.0)])
    put(1, [(t0 + dt.timedelta(hours=6), "a", 4.0)])
    # late rows are judged by the watermark the previous batch reached
    put(2, [(t0 + dt.timedelta(minutes=10), "a", 100.0), (t0 + dt.timedelta(hours=9), "a", 3.0)])
    schema = "ts timestamp, industry_code string, value double"
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = {r.w_start: r.total for r in runs.run_available(runs.stream_windows(src, "tumbling", "1 hour")).collect()}
    assert got[t0] == 1.0 and got[t0 + dt.timedelta(hours=5)] == 2.0


def test_readers(spark, tmp_path):
    (tmp_path / "ev.csv").write_text("﻿event_date,event_type,event_name,affected_industries,direction,magnitude,description\n# note\n2024-01-02,policy,n,\"801,802；803\",+,高,d\n", encoding="utf-8")
    e = R.read_events(spark, str(tmp_path / "ev.csv")).collect()
    assert len(e) == 1 and e[0].affected_industries == ["801", "802", "803"] and e[0].event_date == D(2024, 1, 2)
    (tmp_path / "docs.json").write_text(json.dumps([{"chunk_id": "a", "text": "t", "pub_date": "2024-01-01"}, {"chunk_id": "b", "event_date": "2024-02-01"}, {"chunk_id": "c", "pub_date": "bad"}]))
    d = {r.chunk_id: r for r in R.read_documents(spark, str(tmp_path / "docs.json"), lines=False).collect()}
    assert d["a"].pub_date == D(2024, 1, 1) and d["b"].pub_date == D(2024, 2, 1) and d["c"].pub_time.year == 1970
    (tmp_path / "p.json").write_text(json.dumps({"priors": {"x": {"801": {"direction": -1, "strength": 0.4}}}}))
    p = R.read_priors(spark, str(tmp_path / "p.json")).first()
    assert p.signed_strength == -0.4 and p.verified_agree
    assert R.read_optional(spark, str(tmp_path / "none.csv"), R.MARGIN).count() == 0
    (tmp_path / "a.csv").write_text("event_date,event_VaR\n2024-01-01,-0.1\n")
    (tmp_path / "b.csv").write_text("event_date,event_VaR_T5\n2024-01-01,-0.2\n")
    u = R.read_results(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(r[0] for r in u.select(R.pred_col(u, "event_VaR", 5)).collect()) == [-0.2, -0.1] and u.select(R.pred_col(u, "event_VaR", 20)).first()[0] is None
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    W.save_edges(edges, str(tmp_path / "g"), "2024-01-01")
    W.save_edges(edges.limit(0), str(tmp_path / "g"), "2024-01-01")
    assert W.load_edges(spark, str(tmp_path / "g"), "2024-01-01").count() == 0
    panel = tmp_path / "px.csv"
    panel.write_text("industry_code,industry_name,trade_date,open,high,low,close,volume,amount\n801010,n,2024-01-02,1,1,1,2.5,10,3\n801010,n,bad,1,1,1,2,1,1\n")
    assert [(r.industry_code, r.close) for r in R.read_panel(spark, str(panel)).collect()] == [("801010", 2.5)]


def test_registry_and_sample_oracles(spark):
    import __spark_entry__ as entry

    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) > 180
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    from tools.check import canon

    for n in ("d2_car_diff", "c5_market_snapshot", "i13_backtest_var", "g3_walk_forward_ensemble", "j3_bm25_topk", "k3_subgraph_nodes", "m6_usage"):
        got, want = canon(qs[n](spark, d).toPandas()), canon(con.execute(sqls[n]).fetchdf())
        assert got.equals(want), n
    assert entry.entry(spark).count() > 0


def test_propagation_goes_on_to_the_last_level(spark):
    """Twenty levels of undiminished impact; then a loop that must end."""
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(21)], "node string, rank int")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0, 1.0, None, None) for i in range(20)] + [("n20", "n20", 1.0, 1.0, None, None)],
                                  "src string, dst string, weight double, confidence double, ttl_days double, created_at date")
    got = {r.node: r.level for r in G.propagate(nodes, edges, nodes.filter("node = 'n0'").select("node"), F.lit("2024-01-01").cast("date")).collect()}
    assert got == {f"n{i}": i for i in range(21)}


def test_cycles_in_deep_graphs(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(120)]
    frame = lambda rows: spark.createDataFrame(rows, "source string, target string")
    assert not G.has_cycle(frame(chain + [("c5", "c90"), ("x", "c7")]))
    assert G.has_cycle(frame(chain + [("c120", "c0")]))
    assert G.has_cycle(frame([("a", "b"), ("b", "b")])) and G.has_cycle(frame([("a", "b"), ("b", "a")])) and not G.has_cycle(frame([("a", "b"), ("a", "c"), ("c", "b")]))


def test_cheapest_path_may_be_the_longest(spark):
    """Eight cheap edges beat one dear edge; edges and the evidence union come along and feed the counterfactual."""
    rows = [(f"p{i}", f"p{i + 1}", 0.99, 0.9, [f"d{i}", "d0"]) for i in range(8)] + [("p0", "p8", 0.2, 0.9, ["z"]), ("p2", "p0", 0.9, 0.9, ["y"]), ("q", "p3", 0.9, 0.9, ["w"])]
    e = spark.createDataFrame(rows, "source string, target string, w double, confidence double, evidence_ids array<string>")
    got = G.causal_paths(e, "p0", "p8", 2)
    a, b = got.orderBy("rank").collect()
    assert a.hops == 8 and a.nodes == [f"p{i}" for i in range(9)] and a.evidence_ids == sorted({f"d{i}" for i in range(8)}) and [x.source for x in a.edges] == a.nodes[:-1]
    assert b.nodes == ["p0", "p8"] and b.evidence_ids == ["z"]
    flipped = G.flip_first_edge(got).filter("rank = 1").first().edges
    assert [x.relation for x in flipped] == ["contradicts"] + ["affects"] * 7


def test_pagerank_reports_failure(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0)], "source string, target string, weight double")
    with pytest.raises(ArithmeticError):
        G.pagerank(e, tol=1e-12, rounds=3)
