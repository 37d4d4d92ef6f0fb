"""Hard negatives against all pairs; certified termination; edges."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evq.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, extra string"


def plain(rows, positives=5, negatives=3, every=50, band=(50, 95)):
    """All results by scoring every anchor against every row."""
    sound = [(i, [math.floor(256 * x) for x in v], lab, k) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for i, v, lab, k in sound:
        if i % every:
            continue
        near = sorted((-dot(v, w), j, n) for j, w, m, n in sound if m == lab and n != k)[:positives]
        rest = sorted((-dot(v, w), j, n) for j, w, m, n in sound if m != lab)
        for s, j, _ in near:
            fit = [x for x in rest if band[0] * -s <= 100 * -x[0] and 100 * -x[0] <= band[1] * -s][:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def mined(df, every=50, **options):
    return sorted(tuple(r) for r in hardneg.mine(df, F.col("id") % every == 0, **options).collect())


def cloud(n, d, seed, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    v = centres[rng.integers(8, size=n)] * 0.4 + rng.normal(size=(n, d)) * 0.15
    return [(int(i), [float(x) for x in v[i]], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"members": 3, "clusters": 4, "block_bytes": 1}, {"positives": 2, "negatives": 5, "band": (20, 100)}])
def test_equal_to_all_pairs(spark, options):
    """One block or many, whole clusters or slices of three members."""
    rows = cloud(900, 12, 3)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    want = plain(rows, every=20, **{k: v for k, v in options.items() if k in ("positives", "negatives", "band")})
    assert len(want) > 100 and mined(df, 20, **options) == want


def test_ties_repeated_rows_and_a_hot_vector(spark):
    """A third of all rows hold one vector; equal scores go by id; an anchor that stands twice counts twice."""
    rows = cloud(300, 4, 5) + [(1000 + i, [0.5, 0.25, 0.0, 0.1], i % 2) for i in range(200)] + [(0, [0.5, 0.25, 0.0, 0.1], 0)] * 2
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    assert mined(df, 10) == plain(rows, every=10)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.7, 0.0], 2), (3, None, 1), (4, [nan, 1.0], 1), (5, [1.0, inf], 2), (6, [1.0, None], 2), (7, [0.8, 0.0], None), (None, [0.8, 0.0], 2),
            (50, [0.0, 0.0], 1), (100, [-1.0, -1.0], 2), (150, [0.5], 3), (200, [], 3), (250, [0.001, -0.001], 1), (8, [0.6, 0.2], 2), (9, [0.95, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).withColumn("q", F.lit(1)).withColumn("row", F.lit("r"))
    assert mined(df) == plain(rows)
    assert mined(df.limit(0)) == [] and mined(df.filter("vec_id % 50 <> 0")) == []


def test_large_components_stay_exact(spark):
    """Scores beyond the whole numbers of floating point are computed in integers; beyond 64 bits they raise."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2_000_000, 2_000_000, size=3)], int(rng.integers(2))) for i in range(200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    assert mined(df) == plain(rows)
    with pytest.raises(ValueError, match="64 bits"):
        hardneg.mine(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e6)), F.col("id") % 50 == 0)


def test_walks_end_early():
    """On clustered vectors a walk scores a part of the list only."""
    rows = cloud(20_000, 16, 9)
    x = np.floor(256 * np.array([r[1] for r in rows]))
    labels, ids = np.array([r[2] for r in rows]), np.arange(len(rows))
    near = np.argsort(-(x @ x[0]))[:40]
    low = np.full((40, 1), hardneg.NONE)
    s = hardneg.make_slice(ids[near], labels[near], x[near], low, np.full_like(low, np.iinfo(np.int64).max))
    best = hardneg.Best(40, 1, 5)
    assert hardneg.search(s, x, ids, ids, labels, True, best) < 0.6 * sum((labels == labels[i]).sum() for i in near)
    for k, i in enumerate(near):
        score = x @ x[i]
        mates = [j for j in ids[labels == labels[i]] if j != i]
        assert best.id[k, 0].tolist() == sorted(mates, key=lambda j: (-score[j], j))[:5]


def test_query(spark):
    from evq.llm.queries import op12

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain(rows)
    assert want and sorted(tuple(r) for r in op12(spark, sf).collect()) == want
