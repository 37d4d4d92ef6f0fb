"""Pruned retrieval against plain computation: as-of vocabulary by segments, BM25 by block bounds."""
import datetime as dt
import math
import random
from collections import Counter

from evq.operators import retrieval as J

DAY = dt.date(2020, 1, 1)


def corpus(n, seed=1):
    """Skewed words, a word in every text, some rare ones, some undated texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        text = ["common", *(words[min(int(rng.paretovariate(0.7)), 399)] for _ in range(rng.choice((5, 20, 60))))]
        if i % 97 == 0:
            text += ["rare"] * (1 + i % 3)
        docs.append((i, " ".join(text), None if i % 50 == 49 else DAY + dt.timedelta(days=i // 9), None))
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id int, text string, pub_date date, valid_from date").repartition(4)


def queries(spark):
    rows = [(k, t, DAY + dt.timedelta(days=d)) for k, (t, d) in enumerate([("common rare", 40), ("common rare", 500), ("w1 w2 common", 90), ("rare rare w300", 30), ("absent", 60), ("common", -5), ("w7 w8 w9 w10 rare", 75)])]
    return rows, spark.createDataFrame(rows, "query_id int, text string, as_of date")


def visible(docs, day):
    return [(i, t.split()) for i, t, p, _ in docs if p is not None and p + dt.timedelta(days=1) <= day]


def test_bm25_is_exact_and_scores_fewer_postings(spark):
    docs = corpus(1500)
    rows, q = queries(spark)
    df = frame(spark, docs)
    got = {}
    for r in J.bm25_topk(q, df, 6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, round(r.score, 6)))
    joined = 0
    for k, text, day in rows:
        seen = visible(docs, day)
        n, avg = len(seen), sum(len(t) for _, t in seen) / max(len(seen), 1)
        score = Counter()
        for w, c in Counter(text.split()).items():
            has = [(i, t.count(w), len(t)) for i, t in seen if w in t]
            joined += len(has)
            for i, tf, dl in has:
                score[i] += c * math.log((n - len(has) + 0.5) / (len(has) + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
        want = sorted(((-round(s, 9), i) for i, s in score.items()))[:6]
        assert [(r, i) for r, i, _ in sorted(got.get(k, []))] == [(r + 1, i) for r, (_, i) in enumerate(want)]
        assert all(abs(s + w[0]) < 1e-5 for (_, _, s), w in zip(sorted(got.get(k, [])), want))
    scored = J.bm25_scored(q, df, 6, block_docs=32).groupBy().sum("n_postings").first()[0]
    assert scored < 0.95 * joined


def test_vocabulary_of_every_date(spark):
    docs = corpus(600, 2)
    days = [DAY + dt.timedelta(days=d) for d in (-3, 1, 2, 5, 20, 21, 40, 66, 900)]
    q = spark.createDataFrame([(i, d) for i, d in enumerate(days)] + [(99, days[3])], "query_id int, as_of date")
    for n, growth in ((12, 1.25), (12, 100.0), (5000, 1.5)):
        got = {}
        for r in J.tfidf_vocabulary(q, frame(spark, docs), n, growth).collect():
            got.setdefault(r.as_of, {})[r.token] = (r.df, r.n)
        for d in days:
            seen = visible(docs, d)
            count, has = Counter(w for _, t in seen for w in t), Counter(w for _, t in seen for w in set(t))
            top = sorted(count, key=lambda w: (-count[w], w))[:n]
            assert got.get(d, {}) == {w: (has[w], len(seen)) for w in top}


def test_segments():
    assert J.date_segments([0, 0, 10, 12, 13, 13, 40], 1.25) == [(0, 1), (2, 3), (4, 5), (6, 6)]
    assert J.date_segments([5], 1.25) == [(0, 0)] and J.date_segments([5, 5, 5], 1.25) == [(0, 2)]


def test_tokens_read_once_give_the_same_lists(spark):
    docs, (_, q) = frame(spark, corpus(300, 4)), queries(spark)
    read = J.tokenised(docs)
    for f in (J.bm25_topk, J.tfidf_topk):
        assert sorted(map(tuple, f(q, docs, 4).collect())) == sorted(map(tuple, f(q, read, 4).collect()))
    assert J.bm25_topk(q.limit(0), docs, 4).count() == 0 and J.tfidf_topk(q.limit(0), docs, 4).count() == 0 and J.bm25_topk(q, docs.limit(0), 4).count() == 0
