"""Rows of the risk queries: looked up by industry and date, without a shuffle of the scenarios."""

import datetime as dt
import random

import pytest

from evq.functions.cols import r6
from evq.operators.events import realized_path
from evq.operators.features import BASELINE, baseline_features
from evq.operators.portfolio import portfolio_view, vol_var
from evq.plans.models_queries import ml_rows
from evq.plans.portfolio_queries import wrows
from evq.sources.sample import Sample

KEYS = ["event_id", "industry_code", "horizon"]


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    """Two industries over ninety weeks; event 3 comes three times, at two dates and without one, event 5 twice."""
    rng, top = random.Random(3), str(tmp_path_factory.mktemp("tables"))
    day = lambda k: dt.datetime(1996, 1, 1) + dt.timedelta(days=k)
    orders = [(i, day(30 + 12 * i), "1-URGENT", "F") for i in range(40)] + [(3, day(400), "2-HIGH", "O"), (3, None, "2-HIGH", "O"), (5, day(90), "1-URGENT", "F"), (None, day(90), "x", "P")]
    lines = [(k % 45, k % 3, day(rng.randrange(630)), 100 + rng.random() * 50, float(rng.randrange(1, 9)), 0.05, 0.02) for k in range(3000)]
    parts = [(0, "A"), (1, "BB"), (2, None)]
    for name, rows, schema in (("orders", orders, "o_orderkey long, o_orderdate timestamp, o_orderpriority string, o_orderstatus string"), ("part", parts, "p_partkey long, p_type string"),
                               ("lineitem", lines, "l_orderkey long, l_partkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_discount double, l_tax double")):
        spark.createDataFrame(rows, schema).write.parquet(f"{top}/{name}.parquet")
    return Sample(spark, top)


def test_rows_are_those_of_the_join_by_event(sample):
    """An event id that comes more than once meets the paths of all its rows."""
    path = realized_path(sample.scn, sample.px, sample.mkt).select(*KEYS, r6("realized_car").alias("realized_car"), r6("realized_mdd").alias("realized_mdd"))
    want = vol_var(sample.res(0), sample.feat).join(path, KEYS).select(*KEYS, "event_date", r6("pred_var").alias("pred_var"), "realized_car", "realized_mdd").collect()
    got = sample.risk_rows().select(*KEYS, "event_date", "pred_var", "realized_car", "realized_mdd").collect()
    show = lambda rows: sorted(tuple(r) for r in rows)
    assert show(got) == show(want)
    assert len({r.event_date for r in got if r.event_id == 3}) == 2
    assert sum(r.event_id == 5 for r in got) == 4 * len({(r.industry_code, r.horizon) for r in got if r.event_id == 5})


def test_baseline_rows_are_those_of_the_join_by_event(sample):
    b = baseline_features(sample.scn, sample.px, sample.mkt).select(*KEYS[:2], *BASELINE)
    show = lambda df: sorted(map(str, df.select(*KEYS[:2], "event_date", "prob_up", *BASELINE).collect()))
    assert show(ml_rows(sample)) == show(sample.res(0).join(b, KEYS[:2]))


@pytest.mark.parametrize("rows", [wrows, ml_rows])
def test_scenarios_are_not_shuffled(spark, sample, rows):
    """With every join above the size for an unasked broadcast, neither the paths nor the three horizons gather the rows."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows(sample)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_weights_of_a_horizon(sample):
    n = {r.horizon: r.n for r in portfolio_view(wrows(sample)).filter("abs(hhi * n - 1) < 1e-9").collect()}
    assert n == {r.horizon: r["count"] for r in sample.risk_rows().groupBy("horizon").count().collect()} and len(n) == 3
