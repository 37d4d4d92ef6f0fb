"""Likelihoods against sums over all state paths, normalisation, and gains over the base score."""
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evq.llm import hmm
from evq.llm.queries import op10


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def check_base(rows, docs):
    """docs: [(id, text)]; rows carry the contract's columns. Rows with one id are compared as a set."""
    c = Counter()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, t in docs:
        if not out(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in docs)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert [w[:5] for w in want] == [g[:5] for g in got]
    assert np.allclose([w[5] for w in want], [g[5] for g in got], rtol=1e-9)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op10(spark, sf).collect()
    check_base(rows, docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_small_head_looks_words_up(spark, sf, monkeypatch):
    """The same result whether a word's count is broadcast or joined."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    a = {r.id: r for r in hmm.score(docs, rounds=1).collect()}
    monkeypatch.setattr(hmm, "HEAD", 1100)
    b = {r.id: r for r in hmm.score(docs, rounds=1).collect()}
    assert all(a[i].n_known == b[i].n_known and a[i].base_score == pytest.approx(b[i].base_score, rel=1e-9) and a[i].score == pytest.approx(b[i].score, rel=1e-6) for i in a)


def test_end_counts_whatever_the_head(spark, monkeypatch):
    """With a head of one word and words more frequent than the end, the end is still known."""
    monkeypatch.setattr(hmm, "HEAD", 1)
    texts = [(i, " ".join(f"w{k}" for k in range(40)) + " w1 w2 w1") for i in range(12)]
    check_base(hmm.score(spark.createDataFrame(texts, "doc_id long, text string"), rounds=1).withColumnRenamed("id", "doc_id").collect(), texts)


def test_edges(spark, edge):
    rows = hmm.score(edge, rounds=1).withColumnRenamed("id", "doc_id").collect()
    check_base(rows, [(r.doc_id, r.text) for r in edge.collect()])
    assert all(math.isfinite(r.score) for r in rows)
    assert hmm.score(edge.limit(0), rounds=1).count() == 0
    only = edge.filter(hmm.held_out(F.col("doc_id")))
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in hmm.score(only, rounds=1).collect())


def random_model(k=3, size=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((size, k)), 0)


def paths(seq, start, move, emit):
    """(probability, states) of every state path."""
    for p in itertools.product(range(len(start)), repeat=len(seq)):
        yield start[p[0]] * emit[seq[0], p[0]] * math.prod(move[p[i - 1], p[i]] * emit[seq[i], p[i]] for i in range(1, len(seq))), p


def test_forward_and_expectations_exact():
    start, move, emit = random_model()
    seqs = [np.array(s) for s in ([0], [1, 2], [4, 3, 2, 1, 0], [2, 2, 2, 0])]
    got = hmm.forward(seqs, start, move, emit)
    assert np.allclose(got, [math.log(sum(p for p, _ in paths(s, start, move, emit))) for s in seqs])
    a, b, c = hmm.expectations(seqs, np.array([True] * 4), start, start, move, emit)
    wa, wb, wc = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        total = sum(p for p, _ in paths(s, start, move, emit))
        for p, z in paths(s, start, move, emit):
            wa[z[0]] += p / total
            for i, w in enumerate(s):
                wc[w, z[i]] += p / total
                if i:
                    wb[z[i - 1], z[i]] += p / total
    assert np.allclose(a, wa) and np.allclose(b, wb) and np.allclose(c, wc)


def test_probabilities_sum_to_one():
    """Over all class sequences of one length, and over the words of a class with one unknown."""
    start, move, emit = random_model(seed=3)
    seqs = [np.array(s) for s in itertools.product(range(5), repeat=4)]
    assert np.exp(hmm.forward(seqs, start, move, emit)).sum() == pytest.approx(1)
    lex = hmm.Lexicon([("", 3), ("the", 5)], {hmm.tail_class("xyz"): (7, 2)}, 15, 4)
    k = hmm.tail_class("xyz")
    assert ((3 + 1) + (4 + 1) + 1) / 10 ** lex.log_size[k] == pytest.approx(1)


def test_rounds_raise_the_likelihood(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 80")
    sums = [hmm.score(docs, rounds=r).filter("not held_out").agg(F.sum("score")).first()[0] for r in (1, 4)]
    assert sums[1] > sums[0]
