"""One-to-one set matching against the plain pass."""
import random

import pytest

from evq.operators import events as E


def plain(a, b):
    """Each set of a in order takes its best free set of b; the first of b on ties."""
    used, out = set(), []
    for i in sorted(a):
        best = None
        for j in sorted(b):
            s = len(a[i] & b[j]) / max(len(a[i] | b[j]), 1)
            if j not in used and (best is None or s > best[0]):
                best = (s, j)
        if best:
            used.add(best[1])
        out.append((i, best[1] if best else None, best[0] if best else None, bool(best) and best[0] == 1))
    return out


@pytest.mark.parametrize(("seed", "na", "nb", "items"), [(1, 25, 30, 6), (2, 40, 25, 40), (3, 30, 31, 3), (4, 12, 3, 200), (5, 0, 4, 5), (6, 5, 0, 5)])
def test_equal_to_the_plain_pass(spark, seed, na, nb, items):
    """Ties, equal sets, sets without a shared item, more sets than partners, empty tables."""
    rng = random.Random(seed)
    draw = lambda n: {i: {rng.randrange(items) for _ in range(rng.choice((1, 2, 5)))} for i in range(n)}
    a, b = draw(na), draw(nb)
    table = lambda t, k: spark.createDataFrame([(i, x) for i, s in t.items() for x in [*s, *list(s)[:1]]], f"{k} int, item int")
    got = E.match_sets(table(a, "a_id"), table(b, "b_id")).collect()
    assert sorted(tuple(r) for r in got) == plain(a, b)


def test_an_early_set_without_overlap_takes_the_first_partner(spark):
    a = spark.createDataFrame([(1, "x"), (2, "p"), (2, "q"), (3, "p")], "a_id int, item string")
    b = spark.createDataFrame([("b1", "p"), ("b1", "q"), ("b2", "z")], "b_id string, item string")
    got = {r.a_id: (r.b_id, r.jaccard, r.exact) for r in E.match_sets(a, b).collect()}
    assert got == {1: ("b1", 0.0, False), 2: ("b2", 0.0, False), 3: (None, None, False)}
