"""Long-group helpers, bootstraps, risk tests and evaluation on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evq.functions.ordered import exact_quantiles, ordered_lag, ordered_rank
from evq.functions import resample
from evq.functions.resample import binomial_quantiles, bootstrap_tails, draw, multinomial_counts, multinomial_sums
from evq.operators import metrics as M
from evq.operators import models as L
from evq.operators import portfolio as P
from evq.operators import risk as R


@pytest.fixture(scope="module")
def skewed(spark):
    """One group owns most rows, and most of its values are equal."""
    rng = np.random.default_rng(5)
    g = np.where(rng.random(2000) < 0.7, "hot", rng.choice(["a", "b"], 2000))
    v = np.where((g == "hot") & (rng.random(2000) < 0.6), 1.0, np.round(rng.normal(size=2000), 3))
    pdf = pd.DataFrame({"g": g, "v": v, "id": np.arange(2000)})
    return pdf, spark.createDataFrame(pdf)


def test_ordered_rank_and_lag(skewed):
    pdf, df = skewed
    want = pdf.sort_values(["g", "v", "id"]).assign(rn=lambda d: d.groupby("g").cumcount() + 1, prev=lambda d: d.groupby("g")["v"].shift()).set_index("id")
    rank = ordered_rank(df, ["g"], ["v", "id"], total="n").toPandas().set_index("id")
    assert (rank["rn"] == want["rn"].reindex(rank.index)).all()
    assert (rank.groupby("g")["n"].first() == pdf.groupby("g").size()).all()
    lag = ordered_lag(df, ["g"], ["v", "id"], "v").toPandas().set_index("id")
    pd.testing.assert_series_equal(lag["prev"].sort_index(), want["prev"].sort_index(), check_names=False)


def test_exact_quantiles(skewed):
    pdf, df = skewed
    got = exact_quantiles(df, ["g"], "v", {"a": 0.35, "b": 0.9, "c": 0.0, "d": 1.0}).toPandas().set_index("g")
    for n, q in (("a", 0.35), ("b", 0.9), ("c", 0.0), ("d", 1.0)):
        np.testing.assert_allclose(got[n].sort_index(), pdf.groupby("g")["v"].quantile(q).sort_index(), atol=1e-12)


@pytest.mark.parametrize(("n", "reps"), [(7, 4000), (300, 4000), (20_000, 4000), (30_000_000, 150)])
def test_replicate_means_have_the_right_spread(spark, n, reps):
    """Variance and interval width of replicate means against theory, for any n at equal cost."""
    p = (0.2, 0.5, 0.3)
    k = [round(n * x) for x in p[:2]]
    counts = spark.createDataFrame([(-1.0, k[0]), (0.0, k[1]), (1.0, n - sum(k))], "v double, n long")
    r = multinomial_sums(counts, ["v"], reps).toPandas()
    assert (r["n"] == n).all() and r["rep"].nunique() == reps
    m = (n - sum(k) - k[0]) / n
    var = ((n - k[1]) / n - m * m) / n
    means = r["v"] / n
    assert abs(means.var() / var - 1) < 5 * (2 / reps) ** 0.5 and abs(means.mean() - m) < 5 * (var / reps) ** 0.5
    if n == 20_000:
        assert abs((means.quantile(0.975) - means.quantile(0.025)) / (2 * 1.96 * var**0.5) - 1) < 0.05


def test_continuous_values_in_chunks(spark, monkeypatch):
    """Distinct values over many chunks and a group column; the totals are those of n draws."""
    monkeypatch.setattr(resample, "CHUNK", 64)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], [500, 37]), "v": rng.normal(size=537), "n": 1})
    r = multinomial_sums(spark.createDataFrame(pdf), ["v"], 600, ["g"]).toPandas()
    for g, x in pdf.groupby("g")["v"]:
        means = r[r.g == g]["v"] / len(x)
        assert (r[r.g == g]["n"] == len(x)).all() and len(means) == 600
        assert abs(means.std() / (x.std(ddof=0) / len(x) ** 0.5) - 1) < 0.1


def test_binomial_quantiles():
    u = np.array([0.0, 1e-9, 0.3, 0.5, 0.999])
    for n, p in ((1, 0.5), (10, 0.3), (40, 0.9), (500, 0.01)):
        cdf = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        assert (binomial_quantiles(np.full(5, n), p, u) == np.minimum(np.searchsorted(cdf, u), n)).all()
    assert (binomial_quantiles(np.full(5, 9), 0.0, u) == 0).all() and (binomial_quantiles(np.full(5, 9), 1.0, u) == 9).all()


def test_draws_are_uniform_and_unrelated(spark):
    d = spark.range(200000).select((F.col("id") % 400).alias("r"), F.floor(F.col("id") / 400).alias("s")).select("r", "s", draw(F.col("r"), F.col("s"), F.lit(10)).alias("i")).toPandas()
    assert abs(d["i"].value_counts(normalize=True) - 0.1).max() < 0.004
    table = d.pivot(index="s", columns="r", values="i").to_numpy(dtype=float)
    c = np.corrcoef(table.T)
    assert np.abs(c[np.triu_indices(400, 1)]).max() < 0.25


def test_kupiec_accepts_and_rejects(spark):
    rows = [("ok", -0.1 if i < 5 else 0.1, -0.05) for i in range(100)] + [("bad", -0.1 if i < 20 else 0.1, -0.05) for i in range(100)]
    k = {r.g: r for r in R.kupiec(spark.createDataFrame(rows, "g string, realized_car double, pred_var double"), ["g"]).collect()}
    assert k["ok"].kupiec_p > 0.05 and k["bad"].kupiec_p < 0.05 and k["bad"].n_breach == 20


def test_christoffersen_clustering(spark):
    rows = [("clustered", i, -0.1 if 40 <= i < 50 else 0.1) for i in range(100)] + [("scattered", i, -0.1 if i % 10 == 0 else 0.1) for i in range(100)]
    df = spark.createDataFrame([(*r, -0.05) for r in rows], "g string, i int, realized_car double, pred_var double")
    c = {r.g: r for r in R.christoffersen(df, ["g"], ["i"]).collect()}
    assert c["clustered"].christoffersen_lr > c["scattered"].christoffersen_lr
    assert sum(c["clustered"][x] for x in ("n00", "n01", "n10", "n11")) == 99


def test_var_methods(spark):
    x = np.linspace(-0.05, 0.05, 100)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, d int, r double")
    g = {r.method: r for r in R.risk_grid(df, ["k"], (0.05,), horizons=(1,), reps=50).collect()}
    assert abs(g["historical"]["var"] - np.quantile(x, 0.05)) < 1e-12
    assert all(math.isfinite(r["var"]) and r["es"] <= r["var"] for m, r in g.items() if m != "evt") and math.isfinite(g["evt"]["es"])
    w = 0.94 ** np.arange(99, -1, -1)
    sg = math.sqrt((w * (x - x.mean()) ** 2).sum() / w.sum())
    assert abs(g["ewma"]["var"] - (x.mean() + R.Z[0.05] * sg)) < 1e-9


def test_event_risk_head(spark):
    rows = [("p", i, 0.01 - 0.004 * i, -0.03, 0.04) for i in range(5)]
    paths = spark.createDataFrame(rows, "k string, step int, mean double, lower_95 double, upper_95 double")
    calm, wide = R.event_risk(paths, ["k"]).first(), R.event_risk(paths, ["k"], dispersion=F.lit(0.5)).first()
    assert wide.event_var < calm.event_var and wide.tail_prob > calm.tail_prob and calm.cvar < calm.event_var and 0 <= calm.expected_mdd <= 1
    old = R.event_risk(paths, ["k"], method="legacy").first()
    assert abs(old.event_var + 0.15) < 1e-12


def test_portfolio_view_and_weights(spark):
    rows = [(5, "a", -0.03), (5, "b", -0.01), (5, "b", 0.02)]
    df = spark.createDataFrame(rows, "horizon int, industry_code string, realized_car double").withColumns({c: F.lit(None).cast("double") for c in ("realized_mdd", "realized_downside", "pred_var", "pred_mdd")})
    v = P.portfolio_view(P.resolve_weights(df)).first()
    assert abs(v.realized_car + 0.0066666667) < 1e-9 and abs(v.hhi - 1 / 3) < 1e-12 and abs(v.effective_n - 3) < 1e-9 and v.predicted_var is None
    w = spark.createDataFrame([("a", 2.0), ("b", 0.5)], "industry_code string, weight double")
    got = {r.industry_code: r.weight for r in P.industry_weights(P.resolve_weights(df, w)).collect()}
    assert abs(got["a"] - 2 / 3) < 1e-12 and abs(got["b"] - 1 / 3) < 1e-12
    zero = P.resolve_weights(df, w.withColumn("weight", F.lit(0.0)))
    assert abs(zero.first().weight - 1 / 3) < 1e-12


def test_component_var_adds_up(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.02, (80, 3))
    rets = spark.createDataFrame([("abc"[j], i, float(x[i, j])) for i in range(80) for j in range(3)], "industry_code string, d int, r double")
    w = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "industry_code string, weight double")
    c = P.component_var(rets, w).toPandas().set_index("industry_code").sort_index()
    wv = np.array([0.5, 0.3, 0.2])
    cov = np.cov(x.T)
    vol = math.sqrt(wv @ cov @ wv)
    np.testing.assert_allclose(c["component_var"], wv * (cov @ wv) / vol * R.Z[0.05] * math.sqrt(5), rtol=1e-9)
    assert abs(c["component_var"].sum() - c["portfolio_var"].iloc[0]) < 1e-12


@pytest.mark.parametrize("mode", ["sign", "magnitude", "stoploss"])
def test_backtest_matches_loop(spark, mode):
    rng = np.random.default_rng(9)
    sig, ret = rng.normal(0, 0.01, 30), rng.normal(0, 0.03, 30)
    df = spark.createDataFrame([("p", i, float(a), float(b)) for i, (a, b) in enumerate(zip(sig, ret))], "k string, step int, mean double, actual double")
    got = M.backtest(df, ["k"], mode=mode, stop=-0.02).first()
    size = np.ones(30) if mode == "sign" else np.clip(np.abs(sig) / 0.005, 0, 1)
    prev, cum, out, pnl = 0.0, 0.0, False, []
    for s, z, r in zip(np.sign(sig), size, ret):
        p = 0.0 if out else s * z
        pnl.append(p * r - abs(p - prev) * 0.0015)
        cum, prev = cum + pnl[-1], p
        out = out or (mode == "stoploss" and cum < -0.02)
    pnl = np.array(pnl)
    nav = np.cumprod(1 + pnl)
    ex = pnl - 0.02 / 252
    assert abs(got.total_return - (nav[-1] - 1)) < 1e-9 and abs(got.sharpe - ex.mean() / (ex.std() + 1e-8) * math.sqrt(252)) < 1e-6
    assert abs(got.win_rate - (pnl > 0).mean()) < 1e-12


def test_walk_forward_training_sets(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"date": np.sort(rng.integers(0, 30, 300)), "id": np.arange(300)})
    pdf.loc[pdf.index[100:180], "date"] = pdf["date"].iloc[100]  # a date with many rows
    pdf = pdf.sort_values(["date", "id"]).assign(block=lambda d: d["date"] // 5)
    got = L.training_blocks(spark.createDataFrame(pdf), "date", "block", ["date", "id"], 40).toPandas()
    for b in sorted(pdf["block"].unique())[1:]:
        want = pdf[pdf["block"] < b].tail(40)["id"]
        assert set(got[got["fit_block"] == b]["id"]) == set(want)


def test_walk_forward_score_learns(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=400)
    pdf = pd.DataFrame({"date": np.arange(400) // 4, "id": np.arange(400), "x": x, "y": (x + 0.3 * rng.normal(size=400) > 0).astype(int)}).assign(block=lambda d: d["date"] // 20)
    out = L.walk_forward_score(spark.createDataFrame(pdf), ["x"], "y", F.lit(0.5), "date", "block", ["date", "id"]).toPandas()
    assert (out[out["block"] == 0]["prob_up"] == 0.5).all()
    late = out[out["block"] > 1]
    assert ((late["prob_up"] > 0.5) == (late["y"] == 1)).mean() > 0.8


def test_calibrators(spark):
    rng = np.random.default_rng(8)
    x = rng.random(300)
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(300), "x": x, "y": (rng.random(300) < x).astype(int)}))
    for method in ("platt", "isotonic"):
        p = L.fit_calibrator(df, ["x"], "y", ["t"], method)(df).orderBy("x").toPandas()["prob_up"]
        assert p.iloc[-30:].mean() > p.iloc[:30].mean() + 0.3 and p.between(0, 1).all()
    flat = L.fit_calibrator(df.withColumn("y", F.lit(1)), ["x"], "y", ["t"])(df)
    assert flat.select("prob_up").distinct().first()[0] == 0.5


def plain_tails(values, n, reps, alphas):
    """{(rep, alpha): (v, e)} from whole replicates, written out and sorted."""
    r = np.arange(reps)
    c = multinomial_counts(n, r, np.full(reps, sum(n)), "0/")
    out = {}
    for rep in r.tolist():
        x = np.repeat(np.array(values, dtype=float), c[:, rep])
        for a in alphas:
            q = np.quantile(x, a)
            out[rep, a] = (q, x[x <= q + 1e-15].mean())
    return out


def test_bootstrap_tails(spark):
    """Equal to whole replicates for ties, one value, one row, many values; an empty table gives no row."""
    rng = np.random.default_rng(4)
    many = sorted(set(np.round(rng.normal(0, 0.02, 300), 6).tolist()))
    series = {"many": (many, rng.integers(1, 4, len(many)).tolist()), "ties": ([-0.1, 0.0, 0.2], [2, 40, 3]), "flat": ([0.5], [7]), "single": ([0.5], [1]), "two": ([-1.0, 1.0], [1, 1])}
    rows = [(s, float(v), int(k)) for s, (vs, ks) in series.items() for v, k in zip(vs, ks, strict=True)]
    alphas = [0.05, 0.01, 0.5]
    counts = spark.createDataFrame(rows, "s string, x double, n long")
    got = {(r.s, r.rep, r.alpha): (r.v, r.e) for r in bootstrap_tails(counts, "x", alphas, 300, ["s"]).collect()}
    want = {(s, *k): v for s, (vs, ks) in series.items() for k, v in plain_tails(vs, ks, 300, alphas).items()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)
    assert bootstrap_tails(counts.filter("n < 0"), "x", alphas, 300, ["s"]).isEmpty()


def test_bootstrap_tails_in_chunks(spark, monkeypatch):
    """Cut into chunks, replicates stay whole: their quantiles have the mean and spread of an ordinary bootstrap."""
    from evq.functions import resample

    monkeypatch.setattr(resample, "CHUNK", 16)
    rng = np.random.default_rng(5)
    x = np.sort(rng.normal(0, 1, 400))
    counts = spark.createDataFrame([("a", float(v), 1) for v in x], "s string, x double, n long")
    got = bootstrap_tails(counts, "x", [0.05, 0.2], 1000, ["s"]).toPandas()
    draws = rng.choice(x, size=(4000, len(x)))
    for a, part in got.groupby("alpha"):
        q = np.quantile(draws, a, axis=1)
        e = np.array([d[d <= k].mean() for d, k in zip(draws, q, strict=True)])
        assert len(part) == 1000
        for mine, plain in ((part.v, q), (part.e, e)):
            assert abs(mine.mean() - plain.mean()) < 5 * plain.std() / 1000**0.5 and abs(mine.std() / plain.std() - 1) < 0.15
