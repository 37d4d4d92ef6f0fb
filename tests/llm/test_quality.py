"""Classifier against its SQL form; shrinkage; edges."""
import duckdb
import pytest
from pyspark.sql import functions as F

from evq.llm import oracles, quality
from evq.llm.queries import op6


def sql(sf, text):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(text).fetchall()


def test_query(spark, sf):
    want = {r[0]: r[1:] for r in sql(sf, oracles.QUALITY)}
    got = {r.doc_id: (r.p_quality, r.kept) for r in op6(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][1] == want[i][1] and got[i][0] == pytest.approx(want[i][0], abs=2e-6) for i in got)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.classify(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id")
    assert kept.select(F.avg(((F.col("quality") > 0) == F.col("quality_model.kept")).cast("int"))).first()[0] > 0.95


def test_sparse_sites_shrink(spark):
    """A host with two bad labels moves less from the global share than a host with two hundred."""
    rows = [(i, "same plain words", "en", "good") for i in range(600)] + [(1000 + i, "same plain words", "en", "bad") for i in range(200)] + [(2000 + i, "same plain words", "en", "tiny") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", F.when(F.col("source") == "good", (F.col("doc_id") % 10 > 0).cast("int")).otherwise((F.col("doc_id") % 10 == 0).cast("int") * (F.col("source") == "bad").cast("int")).alias("quality"))
    p = {r.source: r.p for r in quality.classify(docs, labels).groupBy("source").agg(F.avg("quality_model.site_share").alias("p")).collect()}
    assert p["bad"] < p["tiny"] < p["good"] and abs(p["bad"] - 0.1) < 0.03


def test_edges(spark, edge):
    edge = edge.withColumnRenamed("_Quality_Model", "Quality_Model")
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (6, None), (8, 1)], "doc_id long, quality int")
    for lab in (labels, labels.limit(0)):
        out = quality.classify(edge, lab)
        assert out.columns == [*edge.columns, "_quality_model"] and out.count() == edge.count()
        assert out.filter(F.col("_quality_model.p_quality").isNull()).count() == 0
    assert quality.good_documents(edge, labels.limit(0)).count() == edge.count()
    assert quality.good_documents(edge.limit(0), labels).columns == edge.columns


def test_own_label_is_left_out(spark):
    """Turning a document's label round leaves its own site share as it was and changes that of its site."""
    docs = spark.createDataFrame([(i, "same plain words", "en", f"h{i % 2}") for i in range(60)], "doc_id long, text string, lang string, source string")
    share = []
    for first in (0, 1):
        labels = spark.createDataFrame([(i, first if i == 0 else int(i % 3 > 0)) for i in range(50)], "doc_id long, quality int")
        share.append({r.doc_id: r.site for r in quality.classify(docs, labels).select("doc_id", F.col("quality_model.site_share").alias("site")).collect()})
    assert abs(share[0][0] - share[1][0]) < abs(share[0][52] - share[1][52]) / 5 and share[0][52] < share[1][52]
