"""Merkle manifest against a plain tree; proofs; tampering; edges."""
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from evq.llm import merkle
from evq.llm.queries import op13


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Root and, for each node, its siblings level by level as (left, right)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            lo = a - a % 8
            steps[i].append(("".join(nodes[lo:a]), "".join(nodes[a + 1:lo + 8])))
        nodes, at = [H(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)], [a // 8 for a in at]
    return nodes[0], steps


def plain(leaves):
    """{(by, id, leaf): (subroot, root, steps)} of (by, id, leaf) triples."""
    low = lambda v: (v is not None, "" if v is None else v.encode() if isinstance(v, str) else v)
    groups = {}
    for by, i, x in sorted(leaves, key=lambda t: (low(t[0]), t[1] is not None, t[1] or 0, t[2])):
        groups.setdefault(by, []).append((i, x))
    subs = {by: tree([x for _, x in rows]) for by, rows in groups.items()}
    root, above = tree([s[0] for s in subs.values()])
    return {(by, i, x): (sub, root, steps[j] + up) for (by, rows), (sub, steps), up in zip(groups.items(), subs.values(), above, strict=True) for j, (i, x) in enumerate(rows)}


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (8, 9, 64, 65), (512, 513, 1, 700), (5000,) + (2,) * 80])
def test_trees_of_all_sizes(spark, sizes):
    """One leaf, exact and broken runs and blocks, several rounds, many groups."""
    leaves = [(f"g{k:03d}", i, H(str((k, i)))) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(leaves, "by string, id long, leaf string").repartition(5)
    want = plain(leaves)
    got = merkle.manifest(df).withColumn("folded", merkle.folded(F.col("leaf"), "merkle.steps")).withColumn("proof", merkle.proof_digest("merkle.steps")).collect()
    assert len(got) == len(leaves)
    for r in got:
        sub, root, steps = want[r.by, r.id, r.leaf]
        assert (r.merkle.subroot, r.merkle.root, [tuple(s) for s in r.merkle.steps]) == (sub, root, steps)
        assert r.folded == root and r.proof == H(*[a + b for a, b in steps])


def test_leaf_fields(spark, edge):
    cols = ["doc_id", "source", "lang", "n_chars", "text"]
    got = edge.select(*cols, merkle.leaf(*[F.col(c) for c in cols]).alias("x")).collect()
    assert [r.x for r in got] == [row_leaf([r[c] for c in cols]) for r in got]


def test_edges(spark, edge):
    """Null ids and groups, repeated rows, clashing names, an empty table."""
    docs = edge.withColumnRenamed("_Quality_Model", "MERKLE").withColumn("key", F.lit("k")).withColumn("leaf", merkle.leaf(F.col("doc_id"), F.col("text")))
    out = merkle.manifest(docs, "doc_id", "lang")
    assert out.columns == [*docs.columns, "_merkle"]
    rows = out.collect()
    want = plain([(r.lang, r.doc_id, r.leaf) for r in rows])
    assert len(rows) == edge.count() and {r._merkle.root for r in rows} == {next(iter(want.values()))[1]}
    for r in rows:
        if r.doc_id != 4:
            assert [tuple(s) for s in r._merkle.steps] == want[r.lang, r.doc_id, r.leaf][2]
    assert out.filter(merkle.folded(F.col("leaf"), "_merkle.steps") != F.col("_merkle.root")).count() == 0
    assert merkle.manifest(docs.limit(0), "doc_id", "lang").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fields = lambda r, t: row_leaf([r.doc_id, r.source, r.lang, r.n_chars, t])
    want = plain([(r.lang, r.doc_id, fields(r, r.text)) for r in docs])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r.doc_id: r for r in op13(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        x = fields(r, r.text)
        sub, root, steps = want[r.lang, r.doc_id, x]
        h = fields(r, r.text.translate(lower)) if zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else x
        for a, b in steps:
            h = H(a, h, b)
        g = got[r.doc_id]
        assert (g.leaf, g.subroot, g.root, g.proof_sha256, g.folded_root, g.verified) == (x, sub, root, H(*[a + b for a, b in steps]), h, h == root)
    assert {g.verified for g in got.values()} == {True, False}
