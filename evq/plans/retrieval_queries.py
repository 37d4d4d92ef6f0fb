"""Retrieval queries (J rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.functions.cols import r6
from evq.operators import retrieval as R
from evq.plans.catalog import query

VF = "coalesce(valid_from, pub_date + 1)"
TOK = f"""tk AS (SELECT doc_id, {VF} AS vf, [x for x in regexp_extract_all(lower(text), '[a-z0-9]+') if length(x) > 1] AS t FROM docs),
  dt AS (SELECT doc_id, vf, dl, token, count(*) AS tf FROM (SELECT doc_id, vf, len(t) AS dl, unnest(t) AS token FROM tk) GROUP BY 1, 2, 3, 4)"""
QT = """qt AS (SELECT query_id, as_of, token, count(*) AS qtf FROM (SELECT query_id, as_of, unnest([x for x in regexp_extract_all(lower(text), '[a-z0-9]+') if length(x) > 1]) AS token FROM qry) GROUP BY 1, 2, 3)"""
STAT = """dfq AS (SELECT query_id, token, count(*) AS df FROM qt JOIN dt USING (token) WHERE vf <= as_of GROUP BY 1, 2),
  nn AS (SELECT query_id, count(*) AS n, avg(len(t)) AS avgdl FROM qry JOIN tk ON vf <= as_of GROUP BY 1)"""
BM = """bm0 AS (SELECT query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN dfq USING (query_id, token) JOIN nn USING (query_id) JOIN dt USING (token) WHERE vf <= as_of GROUP BY 1, 2),
  bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm0)"""
TI = """qd AS (SELECT DISTINCT as_of FROM qry), nv AS (SELECT as_of, count(*) AS n FROM qd JOIN tk ON vf <= as_of GROUP BY 1),
  vo AS (SELECT as_of, token, count(*) AS df, any_value(nv.n) AS n FROM qd JOIN nv USING (as_of) JOIN dt ON vf <= as_of GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY sum(tf) DESC, token) <= 512),
  vi AS (SELECT as_of, token, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM vo), dn0 AS (SELECT as_of, doc_id, token, tf * idf AS w FROM dt JOIN vi USING (token) WHERE vf <= as_of),
  dn AS (SELECT as_of, doc_id, sqrt(sum(w * w)) AS dn FROM dn0 GROUP BY 1, 2), qw AS (SELECT query_id, as_of, token, qtf * idf AS qw FROM qt JOIN vi USING (as_of, token)),
  qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY 1),
  ti0 AS (SELECT query_id, doc_id, round(sum(w * qw) / (any_value(dn) * any_value(qn)), 9) AS score FROM qw JOIN dn0 USING (as_of, token) JOIN dn USING (as_of, doc_id) JOIN qn USING (query_id) GROUP BY 1, 2),
  ti AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ti0)"""
RRF = """rr AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query_id, doc_id, rank FROM bm WHERE rank <= {k} UNION ALL SELECT query_id, doc_id, rank FROM ti WHERE rank <= {k}) GROUP BY 1, 2)"""
DEC = """de0 AS (SELECT query_id, doc_id, round(score * exp(-greatest(as_of - pub_date, 0) / 30.0::DOUBLE), 15) AS score FROM rr JOIN qry USING (query_id) JOIN docs USING (doc_id)),
  de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM de0)"""
HIT = "CAST(rank AS INT) AS rank, r6(score) AS score"


def hits(d):
    return d.select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), r6("score").alias("score"))


@query("j1_postings", f"WITH {TOK} SELECT doc_id, CAST(dl AS INT) AS dl, token, tf FROM dt")
def _(s):
    return R.postings(s.docs).select("doc_id", "dl", "token", "tf")


@query("j2_bm25_stats", f"WITH {TOK}, {QT}, {STAT} SELECT query_id, token, coalesce(df, 0) AS df, n, r6(avgdl) AS avgdl FROM qt LEFT JOIN dfq USING (query_id, token) LEFT JOIN nn USING (query_id)")
def _(s):
    qt = R.query_tokens(s.qry)
    posts = R.postings(s.docs.withColumn("vf", R.visible_from()), qt, ["vf"], marker=True)
    return R.bm25_stats(qt, posts).select("query_id", "token", "df", "n", r6("avgdl").alias("avgdl"))


@query("j3_bm25_topk", f"WITH {TOK}, {QT}, {STAT}, {BM} SELECT query_id, doc_id, {HIT} FROM bm WHERE rank <= 10")
def _(s):
    return hits(R.bm25_topk(s.qry, s.docs, 10))


@query("j4_tfidf_topk", f"WITH {TOK}, {QT}, {TI} SELECT query_id, doc_id, {HIT} FROM ti WHERE rank <= 10")
def _(s):
    return hits(R.tfidf_topk(s.qry, s.docs, 10))


VEC = """v0 AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v0 GROUP BY 1),
  v AS (SELECT vec_id, label, i, x / n AS x FROM v0 JOIN vn USING (vec_id)), c0 AS (SELECT label AS query_id, i, avg(x) AS x FROM v GROUP BY 1, 2), cn AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM c0 GROUP BY 1),
  vs AS (SELECT query_id, vec_id AS doc_id, round(sum(c0.x / n * v.x), 9) AS score FROM c0 JOIN cn USING (query_id) JOIN v USING (i) GROUP BY 1, 2),
  vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs)"""


def vectors(s, k):
    v = s.t("embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.col("embedding").alias("vec"))
    return R.vector_topk(R.centroids(v), v, k)


@query("j5_vector_topk", f"WITH {VEC} SELECT query_id, doc_id, {HIT} FROM vt WHERE rank <= 20")
def _(s):
    return hits(vectors(s, 20))


VDATE = "date_add(DATE '1995-01-01', CAST({} * 37 % 2400 AS INT))"


@query("j5_vector_topk_visible", f"""WITH {VEC}, s AS (SELECT query_id, doc_id, score FROM vs WHERE DATE '1995-01-01' + CAST(doc_id * 37 % 2400 AS INT) <= DATE '1996-01-01' + CAST(query_id * 53 % 1000 AS INT)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, {HIT} FROM r WHERE rank <= 20""")
def _(s):
    v = s.t("embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.col("embedding").alias("vec"), F.expr(VDATE.format("vec_id")).alias("vf"))
    q = R.centroids(v).withColumn("as_of", F.expr("date_add(DATE '1996-01-01', CAST(query_id * 53 % 1000 AS INT))"))
    return hits(R.vector_topk(q, v, 20))


@query("j6_rrf", f"WITH {TOK}, {QT}, {STAT}, {BM}, {TI}, {RRF.format(k=10)} SELECT query_id, doc_id, r6(score) AS score FROM rr")
def _(s):
    return R.rrf([R.bm25_topk(s.qry, s.docs, 10), R.tfidf_topk(s.qry, s.docs, 10)]).select("query_id", "doc_id", r6("score").alias("score"))


@query("j7_decay_rerank", f"WITH {TOK}, {QT}, {STAT}, {BM}, rr AS (SELECT query_id, doc_id, score FROM bm WHERE rank <= 20), {DEC} SELECT query_id, doc_id, {HIT} FROM de WHERE rank <= 10")
def _(s):
    b = R.bm25_topk(s.qry, s.docs, 20).drop("rank")
    return hits(R.decay_rerank(b, s.qry, s.docs, 10))


@query("j8_retrieve", f"WITH {TOK}, {QT}, {STAT}, {BM}, {TI}, {RRF.format(k=16)}, {DEC} SELECT query_id, doc_id, CAST(rank AS INT) AS rank FROM de WHERE rank <= 8")
def _(s):
    return R.retrieve(s.qry, s.docs, 8).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"))


DENSE = """dq AS (SELECT qry.query_id, as_of, i, c0.x / n AS x FROM qry JOIN c0 ON c0.query_id = qry.query_id % 10 JOIN cn ON cn.query_id = c0.query_id),
  dv AS (SELECT dq.query_id, vec_id AS doc_id, round(sum(dq.x * v.x), 9) AS score FROM dq JOIN v USING (i) JOIN docs ON docs.doc_id = v.vec_id WHERE coalesce(valid_from, pub_date + 1) <= as_of GROUP BY 1, 2),
  de1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dv),
  rr AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query_id, doc_id, rank FROM bm WHERE rank <= 16 UNION ALL SELECT query_id, doc_id, rank FROM ti WHERE rank <= 16
    UNION ALL SELECT query_id, doc_id, rank FROM de1 WHERE rank <= 16) GROUP BY 1, 2)"""


@query("j8_retrieve_dense", f"WITH {TOK}, {QT}, {STAT}, {BM}, {TI}, {VEC}, {DENSE}, {DEC} SELECT query_id, doc_id, CAST(rank AS INT) AS rank FROM de WHERE rank <= 8")
def _(s):
    """Three lists: BM25, TF-IDF and the vectors of the documents against a label's centroid."""
    v = s.t("embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.col("embedding").alias("vec"))
    q = s.qry.select("query_id", "as_of", (F.col("query_id") % 10).alias("_l")).join(R.centroids(v).withColumnRenamed("query_id", "_l"), "_l")
    dated = v.join(s.docs.select("doc_id", R.visible_from().alias("vf")), "doc_id")
    return R.retrieve(s.qry, s.docs, 8, dense=R.vector_topk(q, dated, 16)).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"))


@query("j9_packages", f"""WITH {TOK}, {QT}, {STAT}, {BM}, w AS (SELECT doc_id, len(regexp_split_to_array(regexp_replace(text, '^ +| +$', '', 'g'), '\\s+')) AS k FROM docs)
  SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS doc_ids, CAST(floor(round(sum(k) * 1.3, 6)) AS BIGINT) AS tokens_est FROM bm JOIN w USING (doc_id) WHERE rank <= 5 GROUP BY 1""")
def _(s):
    p = R.packages(R.bm25_topk(s.qry, s.docs, 5), s.docs)
    return p.select("query_id", F.array_join(F.transform("chunks", lambda c: c["doc_id"].cast("string")), ",").alias("doc_ids"), "tokens_est")


TRUTH = """td AS (SELECT doc_id, pub_date - CAST(doc_id % 3 AS INT) AS event_date FROM docs WHERE pub_date IS NOT NULL), tr AS (SELECT td.event_date, doc_id FROM td JOIN docs USING (doc_id) WHERE pub_date <= event_date + 1)"""


@query("j10_retrieval_truth", f"WITH {TRUTH} SELECT event_date, event_date + 1 AS as_of, doc_id FROM tr WHERE event_date IN (SELECT event_date FROM ev)")
def _(s):
    d = s.docs.withColumn("event_date", F.date_sub("pub_date", (F.col("doc_id") % 3).cast("int")))
    return R.retrieval_truth(s.ev, d)


@query("j11_retrieval_quality", f"""WITH {VEC}, h AS (SELECT query_id, doc_id, rank, label = query_id AS ok FROM vt JOIN (SELECT vec_id AS doc_id, label FROM embeddings) USING (doc_id) WHERE rank <= 20),
  r AS (SELECT label AS query_id, count(*) AS n_rel FROM embeddings GROUP BY 1), g AS (SELECT query_id, count(*) FILTER (ok) AS nh, min(rank) FILTER (ok) AS f, count(*) AS nr FROM h GROUP BY 1)
  SELECT count(*) AS n_queries, r6(avg(coalesce(nh, 0) / CAST(n_rel AS DOUBLE))) AS recall_at_k, r6(avg(coalesce(1.0 / f, 0))) AS mrr, r6(sum(nh) / CAST(sum(least(n_rel, nr)) AS DOUBLE)) AS citation_coverage, 1 AS firewall_pass FROM r LEFT JOIN g USING (query_id)""")
def _(s):
    truth = s.t("embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"))
    q = R.retrieval_quality(vectors(s, 20), truth)
    return q.select("n_queries", *[r6(c).alias(c) for c in ("recall_at_k", "mrr", "citation_coverage")], "firewall_pass")
