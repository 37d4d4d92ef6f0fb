"""Near-duplicates of the pipeline against all pairs by plain sets."""
import random

import corpus_pipeline
from evq.llm import neardup


def plain_set(text):
    words = (text or "").split()
    return frozenset(" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_components(texts):
    """{id: smallest id reachable}."""
    sets, left, out = {i: plain_set(t) for i, t in texts.items()}, set(texts), {}
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            seen.add(x)
            near = [y for y in left if linked(sets[x], sets[y])]
            left -= set(near)
            todo += near
        out.update(dict.fromkeys(seen, min(seen)))
    return out


def corpus():
    """Copies with one to eight words changed, around the limit, short texts, and one line that most texts hold."""
    rng, texts = random.Random(5), []
    word = lambda: f"w{rng.randrange(4000)}"
    for _ in range(40):
        base = [word() for _ in range(rng.choice((6, 30, 90, 150, 250, 400)))]
        texts.append(base)
        for k in range(1, 9):
            copy = base[:]
            for _ in range(k):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    line = "this line stands in most of the texts word for word".split()
    texts = [t + line if i % 3 else t for i, t in enumerate(texts)] + [line, line[:4], line[:5], [], ["one"], ["one"]]
    return {i: " ".join(t) for i, t in enumerate(texts)}


def test_all_pairs_of_the_similarity(spark):
    texts = corpus()
    want = plain_components(texts)
    assert 20 < len(set(want.values())) < len(texts) - 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    for common in (3, neardup.COMMON):
        assert {r.id: r.component_id for r in neardup.near_duplicates(docs, common=common).collect()} == want
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()) == sorted(set(want.values()))


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text.lower() for r in docs.collect()}
    got = {r.id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == plain_components(texts)


def test_bucket_counts_never_exclude_a_link(spark):
    """The bound holds for every pair, drops unlike pairs, and very many equal buckets count as unbounded."""
    import numpy as np

    rng = np.random.default_rng(2)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 63, size=rng.integers(1, 400)).astype(np.uint64)
        sets += [np.unique(base), np.unique(np.concatenate((base[len(base) // 12:], rng.integers(0, 1 << 63, size=len(base) // 12).astype(np.uint64)))), np.unique(base[:len(base) * 6 // 10])]
    sets.append(np.arange(70000, dtype=np.uint64) << np.uint64(8))
    nodes = spark.createDataFrame([(i, bytearray(neardup.bucket_counts(s))) for i, s in enumerate(sets)], "node long, counts binary")
    pairs = [(i, j) for j in range(len(sets)) for i in range(j)]
    got = {(r.a, r.b) for r in neardup.possible(spark.createDataFrame(pairs, "a long, b long"), nodes).collect()}
    links = {(i, j) for i, j in pairs if linked(set(sets[i].tolist()), set(sets[j].tolist()))}
    assert links <= got and len(got) < len(pairs) / 4 and all((i, len(sets) - 1) in got for i in range(len(sets) - 1))


def test_odd_buckets_never_exclude_a_link():
    """Buckets odd in one set alone are at most the shingles not shared, for any two sets; unlike sets are far apart."""
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, size=rng.integers(0, 300)).astype(np.uint64)) for _ in range(20)]
    sets += [np.unique(np.concatenate((s[len(s) // 10:], rng.integers(0, 1 << 63, size=len(s) // 10).astype(np.uint64)))) for s in sets]
    sets.append(np.arange(70001, dtype=np.uint64) << np.uint64(8))
    apart = 0
    for i, a in enumerate(sets):
        for b in sets[:i]:
            differ = sum(int(x ^ y).bit_count() for x, y in zip(*(neardup.odd_buckets(s).view(np.uint64).tolist() for s in (a, b)), strict=True))
            assert differ <= len(np.setxor1d(a, b))
            apart += 9 * differ > len(a) + len(b)
    assert apart > len(sets) * (len(sets) - 1) / 4


def test_common_passage_makes_few_pairs(spark):
    """Texts that share a long passage but little else are equal to brute force, whether or not their pairs are made."""
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = {i: passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice((3, 60)))) for i in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.id: r.component_id for r in neardup.near_duplicates(docs, common=20).collect()} == plain_components(texts)


def test_pair_met_at_many_shingles_is_made_once(spark):
    """Texts that share a run of shingles make one pair, not one for each; every pair that shares one is made."""
    rows = [(s, k, 100, at, k, *[0] * len(neardup.ODD)) for k in range(10) for at, s in enumerate(range(12))]
    rows += [(100 + k // 2, k, 100, 0, k, *[0] * len(neardup.ODD)) for k in range(10, 20)]
    entries = spark.createDataFrame(rows, f"shingle long, node long, n int, at int, label long, {', '.join(f'{c} long' for c in neardup.ODD)}")
    got = [(r.a, r.b) for r in neardup.met_pairs(neardup.with_before(entries)).collect()]
    assert sorted(got) == sorted([(i, j) for j in range(10) for i in range(j)] + [(k, k + 1) for k in range(10, 20, 2)])
