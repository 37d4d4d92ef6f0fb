"""Fingerprints and components against brute force over all pairs."""
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from evq.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    """{fingerprint: set of fingerprints reachable} by scanning all pairs."""
    left, out = set(fps), {}
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            seen.add(x)
            near = [y for y in left if (x ^ y).bit_count() <= 3]
            left -= set(near)
            todo += near
        out.update(dict.fromkeys(seen, seen))
    return out


def check(rows, texts):
    """rows: collected (id, fp, component_id)."""
    fps = [plain_fingerprint(t) for t in texts.values()]
    comp = plain_components(set(fps))
    first = {}
    for i, f in zip(texts, fps, strict=True):
        first[f] = min(first.get(f, i), i)
    want = {i: (f, min(first[y] for y in comp[f])) for i, f in zip(texts, fps, strict=True)}
    got = {r[0]: (r[1] & (1 << 64) - 1, r[2]) for r in rows}
    assert got == want


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(simhash.near_duplicates(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_edges(spark, edge):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {r.id: r for r in rows if r.id is not None}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert {r.component_id for r in rows if r.id == 4} == {4}
    assert all((r.fp & (1 << 64) - 1) == plain_fingerprint(t.text) for r in rows for t in edge.filter(F.col("doc_id").eqNullSafe(r.id)).limit(1).collect() if r.id != 7)
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


def test_hot_bucket_in_tiles(spark):
    """Fingerprints that share two blocks, far more than a tile holds: nothing is lost and pieces stay small."""
    rng = random.Random(3)
    fps = {0x5555 | 1 << 40} | {sum(1 << b for b in {rng.randrange(26, 64) for _ in range(rng.randrange(1, 9))}) | 0x155 for _ in range(900)}
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = simhash.links(nodes, tile=16)
    labels = {r.node & (1 << 64) - 1: r.label & (1 << 64) - 1 for r in simhash.components(edges).collect()}
    want = plain_components(fps)
    for f in fps:
        assert (f in labels) == (len(want[f]) > 1)
        if f in labels:
            assert {g for g in fps if labels.get(g) == labels[f]} == want[f]


def test_tile_forest_dense():
    v = np.array(sorted({1 << i | 1 << j for i in range(40) for j in range(40)} | {0}), dtype=np.uint64)
    a, b = simhash.tile_forest(v)
    assert len(a) == len(v) - 1 and len(set(b.tolist())) == 1


def test_long_chain(spark):
    """A path of 300 nodes is one component."""
    e = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    got = simhash.components(e).collect()
    assert len(got) == 301 and {r.label for r in got} == {0}
