"""Statistics against plain counting; trees by held-out accuracy, constraints and flattening."""
import re
from collections import Counter

import numpy as np

from evq.llm import rules
from evq.llm.queries import op7


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dups, len(covered)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, *_, rep = want = plain(docs[r.doc_id])
        assert tuple(r[c] for c in rules.BASE) == want
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k == (q > 0) for k, q in judged]) > 0.9


def test_held_out_accuracy(spark):
    """Trained on labels of one half, right on the other."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = rules.judge(docs, labels.filter("doc_id % 2 = 0")).select("id", "p_quality").join(labels.filter("doc_id % 2 = 1"), labels["doc_id"] == rules.F.col("id")).toPandas()
    assert ((judged.p_quality >= 0.5) == (judged.quality > 0)).mean() > 0.93


def test_edges(spark, edge):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    for lab in (labels, labels.limit(0)):
        rows = rules.judge(edge, lab).collect()
        assert len(rows) == edge.count()
        texts = {r.doc_id: r.text for r in edge.collect()}
        assert all(tuple(r[c] for c in rules.BASE) == plain(texts[r.id]) for r in rows)
    assert rules.judge(edge.limit(0), labels).count() == 0


def test_monotone_and_flat():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=3000)) > 0).astype(float)
    for sign in (1, -1):
        forest = rules.boost(x, y, [sign, 0, sign], trees=30)
        probe = np.repeat(rng.normal(size=(200, 3)), 21, axis=0)
        for j in (0, 2):
            p = probe.copy()
            p[:, j] = np.tile(np.linspace(-4, 4, 21), 200)
            steps = np.diff(forest.scores(p).reshape(200, 21), axis=1)
            assert (steps * sign >= -1e-9).all()

    def walk(f, row):
        total = f.start
        for n in f.roots:
            while f.left[n] != n:
                n = f.left[n] if row[f.feature[n]] <= f.threshold[n] else f.right[n]
            total += f.value[n]
        return total

    assert np.allclose(forest.scores(x[:50]), [walk(forest, r) for r in x[:50]])


def test_repeated_windows_random():
    rng = np.random.default_rng(6)
    for _ in range(200):
        words = [bytes([97 + k]) for k in rng.integers(0, 2, rng.integers(0, 60))]
        t = b" ".join(words).decode()
        assert rules.repeated_words(words)[0] == plain(t)[4]
