"""Exact duplicates against plain grouping; the heavy split at any threshold; edges."""
import hashlib

from pyspark.sql import functions as F

from evq.llm import exactdedup


def plain(rows):
    """Sorted (id, keep_id, group_size, digest) of (id, text) rows, and how many rows each text keeps."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    low = lambda x: -1 if x is None else x
    return sorted(((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=lambda r: (low(r[0]), r[3]))


def found(docs, **options):
    got = exactdedup.duplicates(docs, **options).collect()
    kept = {}
    for r in got:
        kept[r.digest] = kept.get(r.digest, 0) + r.kept
        assert not r.kept or r.id == r.keep_id
    assert set(kept.values()) <= {1}
    return sorted(((r.id, r.keep_id, r.group_size, r.digest) for r in got), key=lambda r: (-1 if r[0] is None else r[0], r[3]))


def test_heavy_and_light_groups(spark):
    """A third of all rows in one text, many middling groups, single texts; every threshold gives the same rows."""
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 40}" if i % 3 == 1 else f"t{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = plain(rows)
    for heavy in (2, 20, 1024):
        assert found(docs, heavy=heavy) == want
        stay = exactdedup.deduplicated(docs, heavy=heavy)
        assert sorted(r.doc_id for r in stay.collect()) == sorted({r[1] for r in want})


def test_winners_are_all_found_and_exact(spark):
    rows = [(i, f"h{i % 5}" if i % 2 else f"t{i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(9)
    table = docs.select(exactdedup.digest(F.col("text")).alias("digest"), F.struct("id", F.col("id").alias("row")).alias("best"))
    got = {r.digest: (r.best.id, r.group_size) for r in exactdedup.winners(table, heavy=11).collect()}
    assert got == {hashlib.sha256(f"h{k}".encode()).hexdigest(): (max(i for i, t in rows if t == f"h{k}"), 400) for k in range(5)}


def test_edges(spark, edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert found(edge) == plain(rows)
    clash = edge.withColumnRenamed("_Quality_Model", "__ROW").withColumn("digest", F.lit(1)).withColumn("__digest", F.lit(None).cast("int"))
    stay = exactdedup.deduplicated(clash)
    assert stay.columns == clash.columns and stay.count() == len({t or "" for _, t in rows})
    assert exactdedup.duplicates(edge.limit(0)).count() == 0 and exactdedup.deduplicated(edge.limit(0)).columns == edge.columns
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (2, "")], "doc_id long, text string")
    assert found(nulls) == plain([(None, "a"), (None, "a"), (1, None), (2, "")])


def test_normalised_texts(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "a c")], "doc_id long, text string")
    got = {r.id: (r.keep_id, r.kept) for r in exactdedup.duplicates(docs, normalise=F.lower).collect()}
    assert got == {1: (2, False), 2: (2, True), 3: (3, True)}


def test_query(spark, sf):
    from evq.llm.queries import op11

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in op11(spark, sf).collect()) == want


def test_no_python_in_the_plan(spark, sf):
    from evq.llm.queries import op11

    assert "Python" not in op11(spark, sf)._jdf.queryExecution().executedPlan().toString()
