"""The pipeline against brute-force stages on a small table."""
import duckdb
import pandas as pd

import corpus_pipeline
from evq.llm import oracles, pii
from tests.llm import test_decontam, test_neardup, test_pii, test_quality


def frame(con, name, rows):
    con.register(f"{name}_rows", rows)
    con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {name}_rows")


def test_run(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    kept = {r[0] for r in test_quality.sql(sf, oracles.QUALITY) if r[2]}
    docs = docs[docs.doc_id.isin(kept)]
    comp = test_neardup.plain_components(dict(zip(docs.doc_id, docs.text, strict=True)))
    docs = docs[docs.doc_id.isin(set(comp.values()))]
    items = [(str(i), t) for i, t in pd.read_parquet(f"{sf}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False)]
    grams = {tuple(w[j:j + 13]) for _, t in items for w in [test_decontam.words(t)] for j in range(max(1, len(w) - 12))}
    near = lambda t: any(tuple(w[j:j + 13]) in grams for w in [test_decontam.words(t)] for j in range(max(1, len(w) - 12)))
    bad = [i for i, t in zip(docs.doc_id, docs.text, strict=True) if near(t) for n, h, _ in [test_decontam.plain(t, items)] if h and 20 * h >= n]
    docs = docs[~docs.doc_id.isin(bad)].copy()

    def hide(text):
        at, out = 0, ""
        for k, a, b in sorted(test_pii.plain(text), key=lambda s: (s[1], -s[2])):
            if a >= at:
                out, at = f"{out}{text[at:a]}[{k}]", b
        return out + text[at:]

    docs["text"] = [hide(t) for t in docs.text]
    docs["n_chars"] = docs.text.str.len()
    con = duckdb.connect()
    frame(con, "documents", docs)
    drawn = {r[0] for r in con.execute(oracles.MIXING).fetchall() if r[4]}
    want = {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in docs.itertuples() if r.doc_id in drawn}
    got = {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want
    assert len(bad) > 0 and pii.KINDS


def test_stages_keep_columns_and_take_edges(spark, sf, edge):
    docs = edge
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf)
        assert out.columns[:len(docs.columns)] == docs.columns and (k == 4 or len(out.columns) == len(docs.columns))
        docs = out
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, edge.limit(0), sf).count() == 0
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, edge, sf).collect()} >= {1, 4, None}
