"""Composed jobs on the smallest sample tables."""

from evq.plans import jobs
from evq.sources.sample import Sample


def test_jobs_run_end_to_end(spark):
    s = Sample.of(spark, "/root/testdata/sf0.001")
    v = jobs.scenario_vectors(s.scn, s.px, s.mkt, s.val, s.margin)
    n = s.scn.count()
    assert v.count() == n
    wf = jobs.walk_forward_benchmark(v, s.res(0))
    total = wf["summary"].filter("scope = 'all'").first()
    assert total.n == s.res(0).count() and 0 <= total.full_accuracy <= 1
    d = jobs.predict(v, wf["rows"]).groupBy("final_dir").count().collect()
    assert sum(r["count"] for r in d) == n
    rep = jobs.risk_report(s.res(0), s.px, s.mkt, shocks=[("m", -0.05, 1.0)], ranges=[("y", "1998-01-01", "1998-12-31")])
    assert {r.horizon for r in rep["portfolio"].collect()} == {1, 5, 20}
    for name in ("calibration", "risk", "attribution", "components", "synthetic", "historical", "top_losses", "industry"):
        assert rep[name].count() > 0, name
    assert rep["limits"].count() > 0
