"""Raking against its SQL form, targets reached, draws calibrated."""
import pytest
from pyspark.sql import functions as F

from evq.llm import mixing, oracles
from evq.llm.queries import op2
from tests.llm.test_quality import sql


def test_query(spark, sf):
    want = {r[0]: r[1:] for r in sql(sf, oracles.MIXING)}
    got = {r.doc_id: (r.topic, r.tokens, r.probability, r.drawn) for r in op2(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[i][:2] == want[i][:2] and got[i][3] == want[i][3] and got[i][2] == pytest.approx(want[i][2], abs=2e-6) for i in got)


def test_given_targets_are_met(spark):
    rows = [(i, "w " * (i % 50 + 1), ("en", "fr")[i % 3 == 0], f"s{i % 4 * (i % 5 > 0)}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": spark.createDataFrame([(f"s{k}", 0.25) for k in range(4)], "value string, share double"), "lang": spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "value string, share double")}
    out = mixing.mix(docs, targets=targets).select("*", "mixture.*").cache()
    weight = F.sum(F.col("tokens") * F.col("probability"))
    total = out.agg(weight).first()[0]
    for d, share in (("source", 0.25), ("lang", 0.5)):
        assert all(r.w / total == pytest.approx(share, rel=1e-6) for r in out.groupBy(d).agg(weight.alias("w")).collect())
    assert out.agg(F.max("probability")).first()[0] == pytest.approx(1)
    drawn, wanted, spread = out.agg(F.sum(F.col("drawn").cast("int")), F.sum("probability"), F.sum(F.col("probability") * (1 - F.col("probability")))).first()
    assert abs(drawn - wanted) < 5 * spread**0.5


def test_edges(spark, edge):
    out = mixing.mix(edge)
    rows = out.collect()
    assert out.columns == [*edge.columns, "mixture"] and len(rows) == edge.count()
    assert all(r.mixture.probability <= 1 and not (r.text is None and r.mixture.tokens) for r in rows)
    assert len({r.mixture.drawn for r in rows if r.doc_id == 4}) == 1
    assert mixing.mix(edge.limit(0)).count() == 0
    assert mixing.mix(edge.filter("text is null")).filter("mixture.drawn").count() == 0
