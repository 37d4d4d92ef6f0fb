"""Priors from past abnormal returns: pair statistics, shrinkage, as-of, leave-one-out, out-of-time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.functions.cols import clip
from evq.functions.windows import asof_join, past_totals

PAIR = ["event_type", "industry_code"]
# fixed values: (P_pos, sensitivity) anchors, joined by straight lines
ANCHORS = ((0.00, -1.2), (0.20, -1.2), (0.40, -0.5), (0.45, 0.0), (0.55, 0.0), (0.60, 0.5), (0.80, 0.5), (1.00, 1.2))
SUM_NAMES = ("n", "n_pos", "s", "s_pos")


def sums() -> dict[str, Column]:
    up = F.col("car") >= 0
    return {"n": F.lit(1), "n_pos": up.cast("long"), "s": F.col("car"), "s_pos": F.when(up, F.col("car")).otherwise(0.0)}


def piecewise(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation through fixed points, flat outside them."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(points[-1][1])))


def local_sensitivity(p: Column, avg: Column, min_abs: float = 0.005) -> Column:
    """Zero for a small or contradicting mean, else interpolated from the share of positives."""
    agree = F.signum(p - 0.5) * F.signum(avg) > 0
    return F.when((F.abs(avg) >= min_abs) & agree, piecewise(p, ANCHORS)).otherwise(0.0)


def asymmetry_adjust(s: Column, p: Column, r: Column) -> Column:
    """In the gray zone .30 <= P < .45 a loss/gain ratio of .6 to .8 sets the value to -.3 .. -.2."""
    gray = (p >= 0.30) & (p < 0.45) & (r >= 0.60) & (r <= 0.80)
    return F.when(F.coalesce(gray, F.lit(False)), piecewise(r, ((0.60, -0.3), (0.80, -0.2)))).otherwise(s)


def from_sums(df: DataFrame, min_abs: float = 0.005) -> DataFrame:
    """Pair statistics from running or grouped sums n, n_pos, s, s_pos."""
    neg = F.col("n") - F.col("n_pos")
    df = df.withColumns({
        "p_pos": F.try_divide(F.col("n_pos"), F.col("n")), "avg_car": F.try_divide(F.col("s"), F.col("n")),
        "_ap": F.when(F.col("n_pos") > 0, F.try_divide(F.col("s_pos"), F.col("n_pos"))).otherwise(0.0),
        "_an": F.when(neg > 0, F.try_divide(F.col("s") - F.col("s_pos"), neg)).otherwise(0.0)})
    r = F.when((F.col("_ap") > 0) & (F.col("_an") < 0), F.try_divide(F.abs("_an"), F.abs("_ap")))
    df = df.withColumn("asymmetry_r", r)
    s = asymmetry_adjust(local_sensitivity(F.col("p_pos"), F.col("avg_car"), min_abs), F.col("p_pos"), F.col("asymmetry_r"))
    return df.withColumn("s_local", s).drop("_ap", "_an")


def pair_stats(car: DataFrame, min_abs: float = 0.005) -> DataFrame:
    return from_sums(car.groupBy(*PAIR).agg(*[F.sum(c).alias(k) for k, c in sums().items()]), min_abs)


def _shrink(n_full: int, cap: float) -> Column:
    """Weight local by n / n_full against half the type mean plus half the industry mean."""
    shared = 0.5 * F.coalesce(F.try_divide(F.col("se"), F.col("ne")), F.lit(0.0)) + 0.5 * F.coalesce(F.try_divide(F.col("si"), F.col("ni")), F.lit(0.0))
    w = F.least(F.lit(1.0), F.col("n") / float(n_full))
    return clip(w * F.col("s_local") + (1 - w) * shared, -cap, cap)


def _finish(df: DataFrame, n_full: int, cap: float, min_dense: int) -> DataFrame:
    s = _shrink(n_full, cap)
    keep = (F.col("n") > 0) & (F.col("nd") >= min_dense) & (F.abs(s) >= 0.05)
    return df.withColumn("sensitivity", F.when(keep, F.round(F.round(s, 9), 3)))


def _pools(n_pool: int, n_dense: int) -> dict[str, Column]:
    """Per pair: its share in the pool sum, in the pool count and in the dense count."""
    ok = F.col("n") >= n_pool
    return {"ps": F.when(ok, F.col("s_local")).otherwise(0.0), "pn": ok.cast("long"), "pd": (F.col("n") >= n_dense).cast("long")}


def shrinkage_prior(car: DataFrame, n_full: int = 5, cap: float = 1.2, n_pool: int = 2, min_dense: int = 2, n_dense: int = 3,
                    min_abs: float = 0.005) -> DataFrame:
    """Hierarchical sensitivity per pair; pairs of thin event types and tiny values are dropped."""
    st = pair_stats(car, min_abs).withColumns(_pools(n_pool, n_dense))
    e = st.groupBy("event_type").agg(F.sum("ps").alias("se"), F.sum("pn").alias("ne"), F.sum("pd").alias("nd"))
    i = st.groupBy("industry_code").agg(F.sum("ps").alias("si"), F.sum("pn").alias("ni"))
    out = _finish(st.join(e, "event_type").join(i, "industry_code"), n_full, cap, min_dense)
    return out.filter(F.col("sensitivity").isNotNull()).select(*PAIR, "n", "p_pos", "avg_car", "s_local", "sensitivity")


def prior_asof(events: DataFrame, car: DataFrame, n_full: int = 5, cap: float = 1.2, n_pool: int = 2, min_dense: int = 2, n_dense: int = 3,
               min_abs: float = 0.005) -> DataFrame:
    """The shrinkage prior every event would have seen, from strictly earlier rows.

    A pair's state changes only on its own dates. Each change is written as a difference
    to the pool sums, so type and industry means are running sums over dates and no pair
    by date product is formed.
    """
    run = from_sums(past_totals(car, PAIR, "event_date", sums(), inclusive=True), min_abs).withColumns(_pools(n_pool, n_dense))
    w = Window.partitionBy(*PAIR).orderBy("event_date")
    diff = run.select(*PAIR, "event_date", *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(c) for c in ("ps", "pn", "pd")])
    e = past_totals(diff, ["event_type"], "event_date", {"se": F.col("ps"), "ne": F.col("pn"), "nd": F.col("pd")}, inclusive=True)
    i = past_totals(diff, ["industry_code"], "event_date", {"si": F.col("ps"), "ni": F.col("pn")}, inclusive=True)
    keys = events.select(*PAIR, "event_date").distinct()
    fact = "fact_d"
    got = asof_join(keys, run.withColumnRenamed("event_date", fact), PAIR, "event_date", fact, ["n", "p_pos", "avg_car", "s_local"])
    got = asof_join(got, e.withColumnRenamed("event_date", fact), ["event_type"], "event_date", fact, ["se", "ne", "nd"])
    got = asof_join(got, i.withColumnRenamed("event_date", fact), ["industry_code"], "event_date", fact, ["si", "ni"])
    got = _finish(got, n_full, cap, min_dense).select(*PAIR, "event_date", F.coalesce("n", F.lit(0)).alias("n_past"), "sensitivity")
    return events.join(got, [*PAIR, "event_date"], "left")


def prior_loo(car: DataFrame, n_full: int = 5, cap: float = 1.2, n_pool: int = 2, min_dense: int = 2, n_dense: int = 3,
              min_abs: float = 0.005) -> DataFrame:
    """The prior without the event's own rows, by subtraction from the totals.

    An event touches the pairs of its own type only; their change is taken from the pool
    sums of that type and industry. No event meets another.
    """
    tot = car.groupBy(*PAIR).agg(*[F.sum(c).alias(k) for k, c in sums().items()])
    own = car.groupBy("event_id", *PAIR).agg(*[F.sum(c).alias(f"o_{k}") for k, c in sums().items()])
    st = from_sums(tot, min_abs).withColumns(_pools(n_pool, n_dense))
    e = st.groupBy("event_type").agg(F.sum("ps").alias("se"), F.sum("pn").alias("ne"), F.sum("pd").alias("nd"))
    i = st.groupBy("industry_code").agg(F.sum("ps").alias("si"), F.sum("pn").alias("ni"))
    full = st.select(*PAIR, *[F.col(c).alias(f"t_{c}") for c in ("n", "n_pos", "s", "s_pos", "ps", "pn", "pd")]).join(e, "event_type").join(i, "industry_code")
    rest = own.join(full, PAIR).withColumns({k: F.col(f"t_{k}") - F.col(f"o_{k}") for k in SUM_NAMES})
    rest = from_sums(rest, min_abs).withColumns(_pools(n_pool, n_dense))
    change = rest.withColumns({c: F.col(c) - F.col(f"t_{c}") for c in ("ps", "pn", "pd")})
    w = Window.partitionBy("event_id", "event_type")
    adj = change.withColumns({"se": F.col("se") + F.sum("ps").over(w), "ne": F.col("ne") + F.sum("pn").over(w), "nd": F.col("nd") + F.sum("pd").over(w),
                              "si": F.col("si") + F.col("ps"), "ni": F.col("ni") + F.col("pn")})
    return _finish(adj, n_full, cap, min_dense).select("event_id", *PAIR, F.col("n").alias("n_rest"), "sensitivity")


def prior_oot(car: DataFrame, year: int, **kw) -> DataFrame:
    """Fit on rows up to a year, score the later rows by the sign of the prior."""
    fit = shrinkage_prior(car.filter(F.year("event_date") <= year), **kw).select(*PAIR, "sensitivity")
    later = car.filter(F.year("event_date") > year).join(fit, PAIR)
    return later.withColumn("hit", (F.col("sensitivity") >= 0) == (F.col("car") >= 0))


def apply_prior(rows: DataFrame, prior: DataFrame, clamp_negative: bool = False, default: float = 1.0) -> DataFrame:
    """Look up the sensitivity of each row's pair, one if unknown, negatives to zero if asked."""
    j = rows.join(prior.select(*PAIR, F.col("sensitivity").alias("_s")), PAIR, "left")
    s = F.coalesce("_s", F.lit(default))
    return j.withColumn("sensitivity", F.greatest(s, F.lit(0.0)) if clamp_negative else s).drop("_s")


def conviction(events: DataFrame, car: DataFrame) -> DataFrame:
    """Sign consistency 2|P - .5| and count of each pair's strictly earlier rows."""
    run = past_totals(car, PAIR, "event_date", {"n": F.lit(1), "n_pos": sums()["n_pos"]}, inclusive=True).withColumnRenamed("event_date", "fact_d")
    got = asof_join(events, run, PAIR, "event_date", "fact_d", ["n", "n_pos"])
    p = F.try_divide(F.col("n_pos"), F.col("n"))
    return got.withColumns({"conviction": F.coalesce(2 * F.abs(p - 0.5), F.lit(0.0)), "n_past": F.coalesce("n", F.lit(0).cast("long"))}).drop("n", "n_pos")


def recalibrate_strength(base: Column, conv: Column, n: Column) -> Column:
    """Signed strength scaled by consistency; times .3 under three rows; zero without history."""
    return F.when(n == 0, 0.0).when(n < 3, base * conv * 0.3).otherwise(base * conv)


def _blend(net: Column, sig: Column, lam: Column, scale: float) -> tuple[Column, Column]:
    own = F.tanh(net / scale)
    envelope = F.when(F.abs(net) > 1e-6, F.abs(net)).otherwise(1.0)
    return (1 - lam) * own + lam * sig, envelope / F.greatest(F.abs(own), F.lit(1e-6))


def blend_prior(rows: DataFrame, mode: str = "soft", net: str = "net_signal", lam: float = 0.35, lam_max: float = 0.6, scale: float = 2.0,
                froth: str | None = None, froth_beta: float = 0.5) -> DataFrame:
    """Blend the prior (direction, strength, verified, conviction, n_past) into a net signal.

    soft: fixed weight on a recalibrated strength. gated: weight grows with pre-event
    conviction; unverified, thin or mixed cells leave the signal as it is.
    """
    x, d = F.col(net), F.col("prior_direction")
    known = d.isNotNull()
    if mode == "soft":
        st = recalibrate_strength(F.col("prior_strength"), F.col("conviction"), F.col("n_past"))
        sig = F.when(d == 0, st).otherwise(d * F.abs(st))
        mix, gain = _blend(x, sig, F.lit(lam), scale)
        own_small = F.abs(F.tanh(x / scale)) <= 1e-6
        env = F.when(F.abs(x) > 1e-6, F.abs(x)).otherwise(1.0)
        out = F.when(own_small, mix * env).otherwise(mix * gain)
        return rows.withColumns({"blended": F.when(known, out).otherwise(x), "reason": F.when(known, "applied").otherwise("none")})
    reason = (F.when(~known, "none").when(~F.coalesce("prior_verified", F.lit(True)), "unverified")
              .when((d == 0) | (F.col("n_past") < 3) | (F.col("conviction") <= 0), "abstain").otherwise("gated"))
    lam_eff = lam_max * F.col("conviction")
    if froth:
        lam_eff = lam_eff * clip(1 + froth_beta * F.coalesce(F.col(froth), F.lit(0.0)) * d, 0, 1.5)
    mix, gain = _blend(x, d * F.col("conviction"), lam_eff, scale)
    return rows.withColumn("reason", reason).withColumn("blended", F.when(F.col("reason") == "gated", mix * gain).otherwise(x))
