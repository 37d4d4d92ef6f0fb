"""Transducer counts against the tokenizers library."""
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evq.llm import tokencount
from evq.llm.queries import op5

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merger():
    return tokencount.Merger(tokencount.load_rules(PATH)[0])


def want(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_query(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5(spark, sf).collect()
    assert [r.n_tokens for r in rows] == want(library, [docs[r.doc_id] for r in rows])
    assert all(r.n_bytes == len(docs[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 1024) for r in rows)


def test_random_mixtures(library, merger):
    rng = random.Random(1)
    pool = ["'", "s", "t", "re", "ve", "ll", "l", "r", "v", "e", " ", "  ", "\n", "\t", "1", "!", "é", " the", "\0", " ", "\x85", "\x1c", "　", "漢字", "😀", "é", "²", "Ⅷ", "<|endoftext|>", "<|endof", "'S"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(4000)]
    texts += [None, "", "it's we're they'll I'd o'reilly 'tis 'rex x've 'v 'l 'll' ''s !'s\n's \t's", "a" * 3000, " " * 700 + "x", "\n" * 700 + "x", "'" * 99 + "s", "x'r", "x'l", "word " * 3000]
    assert tokencount.count_texts(texts, merger, ["<|endoftext|>"]) == want(library, texts)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tokencount, "STATES", 50)
    monkeypatch.setattr(tokencount, "CACHE", 20)
    m = tokencount.Merger(tokencount.load_rules(PATH)[0])
    texts = [f"some words number {i} unbelievable antidisestablishmentarianism {i * i}" for i in range(60)]
    for i in range(0, 60, 5):
        assert tokencount.count_texts(texts[i:i + 5], m, []) == want(library, texts[i:i + 5])


def test_chunk_maps_agree_with_reading_in_sequence():
    nexts, emits = tokencount.splitter()
    kinds = np.random.default_rng(2).integers(0, 12, 5000).astype(np.uint8)
    kinds[-1] = tokencount.RESET
    s, begin = 0, set()
    for i, k in enumerate(kinds.tolist()):
        e, s = emits[s * 12 + k], nexts[s * 12 + k]
        begin |= ({i} if e & 1 else set()) | ({i - 1} if e & 2 else set())
    assert sorted(begin) == tokencount.starts(kinds).tolist()


def test_edges(spark, edge, library):
    rows = tokencount.count_tokens(edge, PATH).collect()
    texts = [r.text for r in edge.collect()]
    assert sorted(r.n_tokens for r in rows) == sorted(want(library, texts))
    assert sorted(r.n_bytes for r in rows) == sorted(len((t or "").encode()) for t in texts)
    assert tokencount.count_tokens(edge.limit(0), PATH).count() == 0
