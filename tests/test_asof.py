"""Firewall, as-of joins and event-study numbers against plain pandas and numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evq.functions.windows import asof_join, past_totals
from evq.operators import asof as A
from evq.operators import events as E
from evq.operators import features as X
from evq.operators import portfolio as P
from evq.operators import priors as R

D = dt.date


def day(n):
    return D(2020, 1, 1) + dt.timedelta(days=int(n))


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(7)
    rows, mk = [], []
    for k in range(140):
        if k % 7 in (5, 6):
            continue
        mk.append((day(k), float(100 * np.exp(0.01 * rng.normal()))))
        for code in ("aa", "bb"):
            if code == "bb" and k in (30, 31):
                continue
            rows.append((code, day(k), float(50 * np.exp(0.1 * rng.normal())), float(1000 + 100 * rng.random())))
    panel = spark.createDataFrame(rows, "industry_code string, d date, close double, volume double")
    mkt = spark.createDataFrame(mk, "d date, mkt_close double")
    ev = [(i, day(n), t, c) for i, (n, t, c) in enumerate([(10, "x", "aa"), (33, "x", "bb"), (40, "y", "aa"), (61, "x", "bb"), (90, "y", "bb"), (95, "x", "aa"), (130, "y", "aa"), (139, "x", "aa")])]
    events = spark.createDataFrame(ev, "event_id long, event_date date, event_type string, industry_code string")
    return panel, mkt, events


def test_visibility_exact_set(spark):
    rows = [("a", D(2020, 1, 1), None), ("b", D(2024, 7, 21), None), ("c", D(2024, 7, 22), None), ("d", D(2024, 7, 25), None), ("e", None, None), ("f", D(2025, 1, 1), D(2019, 1, 1))]
    docs = spark.createDataFrame(rows, "doc_id string, pub_date date, valid_from date")
    t = F.lit("2024-07-22").cast("date")
    assert {r.doc_id for r in docs.filter(A.visible(t)).collect()} == {"a", "b", "f"}
    assert {r.doc_id for r in docs.filter(A.visible(t, "inclusive")).collect()} == {"a", "b", "c", "f"}


@pytest.mark.parametrize("direction,strict", [("backward", True), ("backward", False), ("forward", True), ("forward", False)])
def test_asof_join_matches_pandas(spark, direction, strict):
    rng = np.random.default_rng(3)
    facts = pd.DataFrame({"k": rng.choice(["a", "b"], 60), "t": rng.integers(0, 80, 60)}).drop_duplicates().assign(v=lambda d: np.arange(len(d)))
    probes = pd.DataFrame({"id": range(200), "k": np.where(rng.random(200) < 0.8, "a", "b"), "t": rng.integers(-5, 90, 200)})
    f, p = spark.createDataFrame(facts.rename(columns={"t": "ft"})), spark.createDataFrame(probes)
    got = asof_join(p, f, ["k"], "t", "ft", ["v"], direction, strict).toPandas().sort_values("id")["v"].to_numpy(float)
    want = pd.merge_asof(probes.sort_values("t"), facts.sort_values("t"), on="t", by="k", direction=direction, allow_exact_matches=not strict).sort_values("id")["v"].to_numpy(float)
    np.testing.assert_array_equal(got, want)


def test_past_totals_is_strict(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("a", 5, 8.0)], "k string, t int, v double")
    got = {r.t: r.s for r in past_totals(df, ["k"], "t", {"s": F.col("v")}).collect()}
    assert got == {1: 0.0, 2: 3.0, 5: 7.0}


def test_car_matches_loop(market):
    panel, mkt, events = market
    got = {(r.event_id, r.window): r.car for r in E.car_diff(events, panel, mkt, (1, 5)).collect()}
    wide = panel.toPandas().pivot(index="d", columns="industry_code", values="close").sort_index()
    m = mkt.toPandas().set_index("d")["mkt_close"].sort_index()
    ret, mr = wide.pct_change(fill_method=None).fillna(0), m.pct_change(fill_method=None).fillna(0)
    days = sorted(set(wide.index) & set(m.index))
    want = {}
    for e in events.collect():
        later = [d for d in days if d >= e.event_date]
        for k in (1, 5):
            if later and days.index(later[0]) + k < len(days):
                win = days[days.index(later[0]):days.index(later[0]) + k + 1]
                want[(e.event_id, k)] = round(float((1 + ret.loc[win, e.industry_code]).prod() - (1 + mr.loc[win]).prod()), 6)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_realized_path_drawdown(market):
    panel, mkt, events = market
    r = E.realized_path(events, panel, mkt, (5,)).collect()
    assert r and all(0 <= x.realized_mdd <= 1 and x.n_returns == 6 and x.realized_downside == max(-x.realized_car, 0) for x in r)
    one = next(x for x in r if x.event_id == 2)
    rets = A.dense_returns(panel, mkt).filter("industry_code = 'aa'").toPandas().sort_values("day_idx")
    i = rets.index[rets.d >= one.event_date][0]
    seg = rets.loc[rets.day_idx.between(rets.day_idx[i], rets.day_idx[i] + 5)].fillna(0)
    nav = np.cumprod((1 + seg.r) / (1 + seg.m))
    peak = np.maximum.accumulate(np.r_[1.0, nav])[1:]
    assert abs(one.realized_mdd - ((peak - nav) / peak).max()) < 1e-12 and abs(one.realized_car - (nav.iloc[-1] - 1)) < 1e-12


def _truncated(market, t):
    panel, mkt, events = market
    return panel.filter(F.col("d") < t), mkt.filter(F.col("d") < t), events.filter(F.col("event_date") <= t)


@pytest.mark.parametrize("name", ["market", "valuation", "baseline", "probe", "beta", "matrix", "history"])
def test_truncation_leaves_features_unchanged(market, name):
    """Rows on or after an event must not change what the event sees."""
    t = day(95)

    def build(panel, mkt, events):
        ev = events.filter(F.col("event_date") == t)
        feat = X.features(panel, mkt)
        val = panel.select("industry_code", "d", F.col("close").alias("pe_ttm"), F.col("volume").alias("pb"), (F.col("close") / 100).alias("dividend_yield"))
        return {"market": lambda: X.market_snapshot(ev, feat), "valuation": lambda: X.valuation_snapshot(ev, val, 20), "baseline": lambda: X.baseline_features(ev, panel, mkt),
                "probe": lambda: X.state_probe(ev, feat), "beta": lambda: P.beta_asof(ev, A.dense_returns(panel, mkt)), "matrix": lambda: A.pre_event_matrix(feat, ev, 10),
                "history": lambda: A.history_zscore_stats(feat, ev)}[name]()

    full, cut = build(*market).toPandas(), build(*_truncated(market, t)).toPandas()
    assert len(full) and len(full) == len(cut)
    pd.testing.assert_frame_equal(full.sort_values(list(full.columns)).reset_index(drop=True), cut.sort_values(list(cut.columns)).reset_index(drop=True), atol=1e-9)


def test_cold_start_is_neutral(market):
    panel, mkt, events = market
    r = X.state_probe(events.filter("event_id = 0"), X.features(panel, mkt)).first()
    assert r.confidence == 0.0 and r.pre_state == 0.0


def test_event_window_reasons(market):
    panel, mkt, events = market
    status, rows = A.event_window(X.features(panel, mkt), events, 10, 5)
    got = {r.event_id: r.status for r in status.collect()}
    assert got[0] == "short_before" and got[2] == "ok" and got[7] in ("short_after", "no_rows_after")
    assert {r["count"] for r in rows.groupBy("industry_code", "t0").count().collect()} == {15}


def test_prior_asof_matches_refit(spark):
    rng = np.random.default_rng(11)
    rows = [(i, day(rng.integers(0, 40)), rng.choice(["x", "y"]), rng.choice(["a", "b", "c"]), float(rng.normal(0.02, 0.05))) for i in range(120)]
    car = spark.createDataFrame(rows, "event_id long, event_date date, event_type string, industry_code string, car double")
    got = R.prior_asof(car.drop("car"), car).filter("event_date = DATE '2020-01-26'").select("event_type", "industry_code", "sensitivity").distinct().collect()
    want = {(r.event_type, r.industry_code): r.sensitivity for r in R.shrinkage_prior(car.filter("event_date < DATE '2020-01-26'")).collect()}
    assert got and all(want.get((r.event_type, r.industry_code)) == r.sensitivity for r in got)


def test_prior_loo_matches_refit(spark):
    rng = np.random.default_rng(12)
    rows = [(i // 2, day(i), "x" if i % 4 < 2 else "y", "abc"[i % 3], float(rng.normal(0.02, 0.05))) for i in range(60)]
    car = spark.createDataFrame(rows, "event_id long, event_date date, event_type string, industry_code string, car double")
    got = {(r.event_type, r.industry_code): r.sensitivity for r in R.prior_loo(car).filter("event_id = 7").collect()}
    want = {(r.event_type, r.industry_code): r.sensitivity for r in R.shrinkage_prior(car.filter("event_id <> 7")).collect()}
    assert got and all(want.get(k) == v for k, v in got.items())


def test_blend_rules(spark):
    rows = [(1.0, None, None, None, 0.0, 0), (1.0, 1, 0.1, True, 1.0, 5), (1.0, -1, 1.0, True, 1.0, 9), (1.0, -1, 1.0, False, 1.0, 9), (1.0, -1, 1.0, True, 1.0, 2)]
    df = spark.createDataFrame(rows, "net_signal double, prior_direction int, prior_strength double, prior_verified boolean, conviction double, n_past int")
    soft = [r.blended for r in R.blend_prior(df, "soft").collect()]
    gated = R.blend_prior(df, "gated").collect()
    assert soft[0] == 1.0 and soft[1] > 0 and soft[2] < soft[1]
    assert [r.reason for r in gated] == ["none", "gated", "gated", "unverified", "abstain"] and gated[2].blended < 0 and gated[3].blended == 1.0
