"""Wu-Manber search against a direct comparison at every position."""
import hashlib
import random
import re

from evq.llm import decontam
from evq.llm.queries import op4


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(text, items):
    d, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            for j in range(len(d) - m + 1):
                if d[j:j + m] == w[i:i + m]:
                    hit |= set(range(j, j + m))
                    found.add(item)
    return len(d), len(hit), sorted(x for x in found if x is not None)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 4000}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in op4(spark, sf).collect()}
    for i, t in docs.items():
        n, h, f = plain(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, h, len(f), h > 0 and 20 * h >= n)
        assert r.items_sha256 == hashlib.sha256(",".join(f).encode()).hexdigest()


def test_short_and_overlapping_windows(spark):
    """Items of every length, repeated words, null and equal ids, several benchmark blocks."""
    rng = random.Random(5)
    items = [(str(k) if k else None, " ".join(rng.choice("abc") for _ in range(k % 19))) for k in range(40)] + [("7", "A! b, C"), ("n", None), ("e", "")]
    docs = [(k, " ".join(rng.choice("abcd") for _ in range(k))) for k in range(0, 120, 3)] + [(None, "a b c"), (500, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    want = sorted((i is None, i or 0, *plain(t, items)) for i, t in docs)
    for size in (1 << 20, 60):
        rows = decontam.contamination(d, b, block_bytes=size).collect()
        assert sorted((r.id is None, r.id or 0, r.n_words, r.n_hit, list(r["items"])) for r in rows) == want


def test_edges(spark, edge):
    bench = spark.createDataFrame([("q", "one two")], "item_id string, text string")
    rows = decontam.contamination(edge, bench).collect()
    assert len(rows) == edge.count() and {r.id for r in rows if r.contaminated} == {4, None}
    assert decontam.contamination(edge, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontam.contamination(edge.limit(0), bench).count() == 0
    kept = decontam.clean_documents(edge, bench)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 3


def test_rows_stay_out_of_python(spark, edge):
    """The search reads texts alone: a row's own columns neither go to Python nor come back."""
    bench = spark.createDataFrame([("q", "one two")], "item_id string, text string")
    plan = decontam.clean_documents(edge, bench)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
