"""Expanding baselines: majority before the first fit, past rows only, planted signal found."""

import datetime as dt

import numpy as np
import pytest

from pyspark.sql import functions as F

from evq.functions.boosting import Trees, bin_edges, boost, boost_all
from evq.operators import models as M


def rows(spark, signal_in_text):
    data = []
    for k in range(240):
        up = (k * 7 + k // 3) % 2 == 0
        x = (1.0 if up else -1.0) + ((k * 13) % 10 - 5) / 20
        text = ("gain rise climb" if up else "loss fall drop") if signal_in_text else ("same words" if k % 5 else None)
        data.append((k, dt.date(2000 + k // 60, 1 + k % 12, 1), 2000 + k // 60, "+" if up else "-", None if k == 200 else x, text))
    return spark.createDataFrame(data, "id int, event_date date, block int, real_dir string, x double, text string")


def majority(df):
    return {r.id: r.b1 for r in M.baseline_majority(df).collect()}


@pytest.mark.parametrize("kind", ["logistic", "gbt"])
def test_feature_baseline(spark, kind):
    df = rows(spark, True)
    out = {r.id: r for r in M.baseline_ml(df, ["x"], kind, order=["id"]).collect()}
    b1 = majority(df)
    early = [r.id for r in out.values() if sum(o.event_date < r.event_date and o.x is not None for o in out.values()) < 20]
    assert len(out) == 240 and early and all(out[k].pred == b1[k] for k in early) and out[200].pred == b1[200]
    assert sum(out[k].pred == out[k].real_dir for k in range(60, 240)) > 170


def test_text_baseline(spark):
    df = rows(spark, True)
    out = {r.id: r for r in M.baseline_text(df, order=["id"], n_features=512).collect()}
    b1 = majority(df)
    early = [r.id for r in out.values() if sum(o.event_date < r.event_date for o in out.values()) < 20]
    assert early and all(out[k].pred == b1[k] for k in early)
    assert all(out[k].pred == out[k].real_dir for k in out if k not in early)


def test_text_baseline_sees_only_the_past(spark):
    df = rows(spark, True)
    early = {r.id: r.pred for r in M.baseline_text(df.filter("block <= 2001"), order=["id"], n_features=512).collect()}
    both = {r.id: r.pred for r in M.baseline_text(df, order=["id"], n_features=512).collect()}
    assert all(both[k] == early[k] for k in early if k >= 60)


def test_text_baseline_of_nothing(spark):
    df = rows(spark, False)
    assert M.baseline_text(df, order=["id"], n_features=512).count() == 240
    assert M.baseline_text(df.limit(0), order=["id"]).columns == [*df.columns, "pred"]


def test_warm_started_fits_equal_independent_ones():
    """Weights of a run of growing sets against each set fitted alone, and against a plain gradient condition."""
    rng = np.random.default_rng(3)
    x = rng.poisson(0.4, size=(300, 200)).astype(float)
    y = (x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=300) > 0).astype(float)
    sets = [(x[max(0, n - 250):n], y[max(0, n - 250):n]) for n in range(60, 300, 12)]
    run = M.text_logistic_fits(sets)
    for (v, t), m in zip(sets, run, strict=True):
        w = np.frombuffer(m)
        assert np.abs(w - np.frombuffer(M.text_logistic_fits([(v, t)])[0])).max() < 1e-4
        idf = np.log((len(t) + 1) / ((v > 0).sum(axis=0) + 1))
        p = 1 / (1 + np.exp(-(v @ w[:-1] + w[-1])))
        assert np.abs((v * idf).T @ (p - t) + np.divide(w[:-1], idf, out=np.zeros(200), where=idf > 0)).max() < 1e-5 and abs((p - t).sum()) < 1e-5


def test_every_date_has_its_own_fit(spark):
    """Each date's score is that of an independent fit on all earlier rows, in any grouping of the dates."""
    rng = np.random.default_rng(4)
    data = [(k, dt.date(2001, 1, 1) + dt.timedelta(days=k // 3), float(a), float(b), "+" if a * b + 0.3 * e > 0 else "-") for k, (a, b, e) in enumerate(rng.normal(size=(180, 3)))]
    df = spark.createDataFrame(data, "id int, event_date date, a double, b double, real_dir string")
    x, y, day = np.array([r[2:4] for r in data]), np.array([r[4] == "+" for r in data], float), np.array([r[1] for r in data])
    for kind, most in (("logistic", 1_000), ("gbt", 1_000), ("gbt", 50)):
        out = {r.id: r.pred for r in M.baseline_ml(df, ["a", "b"], kind, order=["id"], rounds=12, max_train=most).collect()}
        b1 = majority(df)
        for d in np.unique(day):
            past = np.flatnonzero(day < d)[-most:]
            own = np.flatnonzero(day == d)
            if (day < d).sum() < 20:
                want = [b1[i] for i in own]
            elif kind == "logistic":
                want = ["+" if z > 0 else "-" for z in M.logistic_score(M.logistic_fit(x[past], y[past]), x[own])]
            else:
                want = ["+" if z > 0 else "-" for z in boost(x[past], y[past], True, 12, 4, 0.05, 0.9, 0.9, 0.0, 5).scores(x[own])]
            assert [out[i] for i in own] == want


@pytest.mark.parametrize("kind", ["logistic", "gbt"])
def test_fits_take_every_earlier_row(spark, kind):
    """The direction follows x in the first 3,000 rows and is unrelated to it in the next 1,200: only a fit on all rows sees it."""
    rng = np.random.default_rng(5)
    data = []
    for k in range(4_400):
        x = float(rng.normal())
        up = x > 0 if k < 3_000 or k >= 4_200 else k % 2 == 0
        data.append((k, dt.date(2001, 1, 1) + dt.timedelta(days=k // 200), x, "+" if up else "-"))
    out = M.baseline_ml(spark.createDataFrame(data, "id int, event_date date, x double, real_dir string"), ["x"], kind, order=["id"], rounds=20).collect()
    late = [r for r in out if r.id >= 4_200]
    assert len(out) == 4_400 and sum(r.pred == r.real_dir for r in late) >= 190


@pytest.mark.parametrize("kind", ["logistic", "gbt"])
def test_every_date_is_fitted_on_all_earlier_rows(spark, kind):
    """Each date's calls are those of an independent fit on all of its more than 1,000 earlier rows, in any grouping of the dates; a row of unknown direction is only scored."""
    rng = np.random.default_rng(6)
    data = [(k, dt.date(2001, 1, 1) + dt.timedelta(days=k // 60), float(a), float(b), "+" if a * b + a + 0.3 * e > 0 else "-") for k, (a, b, e) in enumerate(rng.normal(size=(1_500, 3)))]
    data.append((1_500, data[700][1], 0.1, 0.2, None))
    df = spark.createDataFrame(data, "id int, event_date date, a double, b double, real_dir string")
    x, y, day = np.array([r[2:4] for r in data]), np.array([r[4] == "+" for r in data], float), np.array([r[1] for r in data])
    out = {r.id: r.pred for r in M.baseline_ml(df, ["a", "b"], kind, order=["id"], rounds=6).collect()}
    for d in np.unique(day)[1:]:
        past, own = np.flatnonzero((day < d) & (np.arange(1_501) < 1_500)), np.flatnonzero(day == d)
        if kind == "logistic":
            z = M.logistic_score(M.logistic_fit(x[past], y[past]), x[own])
        else:
            z = boost(x[past], y[past], True, 6, 4, 0.05, 0.9, 0.9, 0.0, 5).scores(x[own])
        assert [out[i] for i in own] == ["+" if v > 0 else "-" for v in z]


@pytest.mark.parametrize("kind", ["logistic", "gbt"])
def test_equal_rows_count_each(spark, kind):
    """900 rows share two feature vectors, most of them up in one and down in the other; rare vectors of 20 rows differ. One row per vector would call both alike."""
    data, k = [], 0
    for day in range(30):
        for x, ups, downs in ((0.0, 20, 4), (1.0, 3, 21), (0.5 + day / 100, 0, 1)):
            for up in [True] * ups + [False] * downs:
                data.append((k, dt.date(2001, 1, 1) + dt.timedelta(days=day), x, "+" if up else "-"))
                k += 1
    out = M.baseline_ml(spark.createDataFrame(data, "id int, event_date date, x double, real_dir string"), ["x"], kind, order=["id"], rounds=20).collect()
    late = {(r.x, r.pred) for r in out if r.event_date > dt.date(2001, 1, 2) and r.x in (0.0, 1.0)}
    assert late == {(0.0, "+"), (1.0, "-")} and len(out) == k


def test_fits_of_nothing(spark):
    """No rows, rows of one direction, rows of null features: the majority baseline."""
    df = spark.createDataFrame([(k, dt.date(2001, 1, 1 + k % 28), None if k % 2 else 1.0, "+") for k in range(60)], "id int, event_date date, x double, real_dir string")
    for kind in ("logistic", "gbt"):
        assert M.baseline_ml(df.limit(0), ["x"], kind, order=["id"]).collect() == []
        for one in (df, df.withColumn("x", F.lit(None).cast("double"))):
            assert [r.pred for r in M.baseline_ml(one, ["x"], kind, order=["id"]).collect()] == ["+"] * 60


def test_boosting_of_counts_is_that_of_repeated_rows():
    """Without a draw the trees of counted rows are those of the rows written out, edges at quantiles included; each of equal rows is drawn with the same chance."""
    rng = np.random.default_rng(8)
    x, c = rng.normal(size=(400, 3)), rng.integers(1, 9, 400)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    many = np.repeat(x, c, axis=0), np.repeat(y, c)
    for a, b in zip(bin_edges(many[0], 32), bin_edges(x, 32, c), strict=True):
        assert (a == b).all()
    a, b = (boost_all([s], True, 40, 4, 0.05, 1.0, 0.9, 0.0, 5)[0].scores(x) for s in (many, (x, y, c)))
    assert np.abs(a - b).max() < 1e-9
    a, b = (boost_all([s], True, 40, 4, 0.05, 0.9, 0.9, 0.0, 5)[0] for s in ((x, y), (x, y, np.ones(400))))
    assert (a.value == b.value).all() and (a.feature == b.feature).all() and (a.limit == b.limit).all()


def test_boosting_splits_like_brute_force():
    """One tree of depth one takes the split of least squared error; many trees fit a product of two features."""
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    t = boost(x, y, False, 1, 1, 1.0, 1.0, 1.0, 0.0, 1)
    loss = {(j, c): ((y - np.where(x[:, j] > c, y[x[:, j] > c].mean(), y[x[:, j] <= c].mean())) ** 2).sum() for j in range(3) for c in np.sort(x[:, j])[:-1]}
    assert ((y - t.scores(x)) ** 2).sum() == pytest.approx(min(loss.values()))
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    m = boost(x[:2000], y[:2000], True, 120, 4, 0.05, 0.9, 0.9, 0.0, 5)
    assert ((m.scores(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.9
    assert (Trees.unpack(m.pack()).scores(x) == m.scores(x)).all()


def test_pool_of_three_models(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(240):
        v = np.sin(np.arange(25) / 3 + k)
        rows.append((f"i{k % 4}", dt.date(2020, 1, 1) + dt.timedelta(days=k // 4), (v[:20] + rng.normal(size=20) * 0.05).tolist(), v[20:].tolist()))
    w = M.temporal_split(spark.createDataFrame(rows, "industry_code string, start_d date, x array<double>, y array<double>"))
    out = M.pool_select(M.forecast_pool(w, rounds=40), ["industry_code", "start_d"]).collect()
    assert len(out) == 240 and {r.n_models for r in out} == {3} and {r.selected for r in out} == {"linear"}


def test_text_features_counts(spark):
    """Terms flushed early add up; a null text has no rows; the weights are those of a plain count."""
    texts = {1: "b a a c", 2: "A b", 3: None, 4: "", 5: "c c c d"}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {}
    for r in M.text_features(df, "doc_id", n_terms=4, top=2, held=2).collect():
        got.setdefault(r.doc_id, []).append((r["rank"], r.term, r.weight))
    idf = {t: np.log(6 / (1 + n)) + 1 for t, n in (("a", 2), ("b", 2), ("c", 2), ("c c", 1))}
    norm = np.sqrt((2 * idf["a"]) ** 2 + idf["b"] ** 2 + idf["c"] ** 2)
    assert set(got) == {1, 2, 5}
    assert sorted(got[1]) == [(1, "a", pytest.approx(2 * idf["a"] / norm)), (2, "b", pytest.approx(idf["b"] / norm))]
    assert [t for _, t, _ in sorted(got[5])] == ["c", "c c"]
