"""Calibration, selection, simple forecasters and walk-forward baselines."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.functions.boosting import Trees, boost, boost_all
from evq.functions.cols import clip
from evq.functions.lineage import cut
from evq.functions.ordered import exact_quantiles
from evq.functions.sizing import settled, spread
from evq.functions.series import mean, total, variance
from evq.functions.windows import past_totals


def _latest(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The latest n rows in time order with rank 1 = earliest of them (bounded by n)."""
    last = df.orderBy(*[F.desc(c) for c in order]).limit(n)
    return last.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))


def _balance(df: DataFrame, label: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy())
    return df.withColumn("_w", n / (2.0 * F.count("*").over(Window.partitionBy(label))))


def fit_calibrator(df: DataFrame, features: Sequence[str], label: str, order: Sequence[str], method: str = "platt", max_train: int = 500):
    """Fit on the first 70 % of the latest max_train rows; returns score(df) adding prob_up.

    platt: class-balanced logistic; isotonic: one feature, ten rows, clipped to [.05, .95].
    Without rows (or with one class) every probability is one half.
    """
    rows = cut(_latest(df.select(*order, *features, F.col(label).cast("double").alias("_y")), order, max_train))
    n, k = rows.agg(F.count("*"), F.countDistinct("_y")).first()
    train = rows.filter(F.col("_rn") <= max(1, int(n * 0.7)))
    if n < 1 or k < 2:
        return lambda x: x.withColumn("prob_up", F.lit(0.5))
    vec = VectorAssembler(inputCols=list(features), outputCol="_f")
    if method == "isotonic" and len(features) == 1 and n * 0.7 >= 10:
        m = IsotonicRegression(featuresCol="_f", labelCol="_y", predictionCol="_p").fit(vec.transform(train))
        return lambda x: m.transform(vec.transform(x)).withColumn("prob_up", clip("_p", 0.05, 0.95)).drop("_f", "_p")
    lr = LogisticRegression(featuresCol="_f", labelCol="_y", weightCol="_w", regParam=1.0 / max(1, int(n * 0.7)), standardization=False,
                            probabilityCol="_pr", predictionCol="_pd", rawPredictionCol="_rw")
    m = lr.fit(vec.transform(_balance(train, "_y")))
    return lambda x: m.transform(vec.transform(x)).withColumn("prob_up", vector_to_array("_pr")[1]).drop("_f", "_pr", "_pd", "_rw")


def logistic_coefficients(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Balanced ridge logistic by Newton steps; the last entry is the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.where(y > 0, len(y) / (2.0 * max(y.sum(), 1)), len(y) / (2.0 * max((1 - y).sum(), 1)))
    pen = np.eye(a.shape[1])
    pen[-1, -1] = 1e-9
    b = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + pen, a.T @ (w * (p - y)) + pen @ b)
        b -= step
        if np.abs(step).max() < 1e-10:
            break
    return b


def training_blocks(rows: DataFrame, date: str, block: str, order: Sequence[str], max_train: int) -> DataFrame:
    """The last max_train rows strictly before each block's first date, with their block.

    Works from per-date counts: at most max_train rows of a date are kept (limited on the
    map side) and a row serves at most the next max_train blocks.
    """
    daily = rows.groupBy(date).agg(F.count("*").alias("n"), F.min(block).alias("_b"))
    cum = daily.select(date, "_b", F.sum("n").over(Window.orderBy(date)).alias("_c"), "n")
    starts = cum.groupBy("_b").agg(F.min(F.col("_c") - F.col("n")).alias("_before"))
    numbered = starts.select(F.col("_b").alias("_t"), "_before", F.row_number().over(Window.orderBy("_b")).alias("_i"))
    own = cum.join(numbered.select(F.col("_t").alias("_b"), F.col("_i").alias("_own")), "_b").select(date, "_c", "_own")
    top = numbered.agg(F.max("_i")).scalar()
    last_i = F.least(F.col("_own") + max_train, F.col("_top"))
    ahead = own.withColumn("_top", top).filter(F.col("_own") < F.col("_top")).withColumn("_i", F.explode(F.sequence(F.col("_own") + 1, last_i)))
    pairs = ahead.join(numbered, "_i").withColumn("_gap", F.col("_before") - F.col("_c")).filter(F.col("_gap") < max_train).select(date, F.col("_t").alias("fit_block"), "_gap")
    last = rows.withColumn("_k", F.row_number().over(Window.partitionBy(date).orderBy(*[F.desc(c) for c in order]))).filter(F.col("_k") <= max_train)
    return last.join(pairs, date).filter(F.col("_gap") + F.col("_k") <= max_train).withColumn("_pos", F.col("_gap") + F.col("_k")).drop("_gap", "_k")


def walk_forward_score(rows: DataFrame, features: Sequence[str], label: str, raw: Column, date: str, block: str, order: Sequence[str],
                       max_train: int = 500, min_rows: int = 30) -> DataFrame:
    """Probability per row from a calibrator refitted at each block on earlier rows only.

    Training sets are bounded by max_train, so the fits run side by side as grouped tasks;
    scores are a dot product on joined coefficients. Under min_rows the raw score is used.
    """
    feats = list(features)
    base = rows.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in feats})
    train = training_blocks(base.select(*feats, F.col(label).cast("double").alias("_y"), date, block, *[c for c in order if c != date]), date, block, order, max_train)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        pdf = pdf.sort_values("_pos", ascending=False)
        head = pdf.iloc[: max(1, int(n * 0.7))]
        y = head["_y"].to_numpy(float)
        ok = n >= min_rows and 0 < y.sum() < len(y)
        coef = logistic_coefficients(head[feats].to_numpy(float), y).tolist() if ok else None
        return pd.DataFrame({block: [pdf["fit_block"].iloc[0]], "n_train": [n], "coef": [coef]})

    t = dict(rows.dtypes)[block]
    coefs = train.select("fit_block", "_pos", "_y", *feats).groupBy("fit_block").applyInPandas(fit, f"{block} {t}, n_train long, coef array<double>")
    j = base.join(coefs, block, "left")
    z = sum((F.col("coef")[i] * F.col(c) for i, c in enumerate(feats)), F.col("coef")[len(feats)])
    return j.withColumn("prob_up", F.coalesce(1 / (1 + F.exp(-z)), raw)).drop("coef")


def threshold_grid(n: int = 15, lo: float = 0.05, hi: float = 0.40) -> list[float]:
    return [round(lo + (hi - lo) * i / (n - 1), 12) for i in range(n)]


def selective_threshold(rows: DataFrame, score: str = "correct", default: float = 0.12, min_all: int = 12, min_type: int = 8,
                        min_coverage: float = 0.2) -> DataFrame:
    """Abstention threshold per row from strictly earlier rows of its type.

    Counts per (type, date) hold one number per grid point; accumulated over dates and
    joined back, so rows never meet the grid.
    """
    grid = threshold_grid()
    good = F.col("dir_correct") if score == "correct" else F.col("real_dir") == "+"
    tot = {"n": F.lit(1)}
    for i, t in enumerate(grid):
        on = F.round("confidence", 12) >= t
        tot[f"m{i}"], tot[f"c{i}"] = on.cast("long"), (on & good).cast("long")
    typed = past_totals(rows, ["event_type"], "event_date", tot)
    every = past_totals(rows, [], "event_date", {"n_all": F.lit(1)})
    cells = []
    for i, t in enumerate(grid):
        cov = F.try_divide(F.col(f"m{i}"), F.col("n"))
        s = F.coalesce(F.try_divide(F.col(f"c{i}"), F.col(f"m{i}")), F.lit(0.0)) + 0.1 * cov
        cells.append(F.when(cov >= min_coverage, F.struct(F.round(s, 12).alias("s"), F.lit(-i).alias("o"), F.lit(t).alias("t"))))
    best = F.array_max(F.filter(F.array(*cells), lambda x: x.isNotNull()))
    pick = typed.join(every, "event_date").select("event_type", "event_date", F.when(
        (F.col("n_all") >= min_all) & (F.col("n") >= min_type), F.coalesce(best["t"], F.lit(default))).otherwise(default).alias("threshold"))
    return rows.join(pick, ["event_type", "event_date"])


def quantile_policy(rows: DataFrame, coverage: float = 0.65, min_rows: int = 5, prob: str = "prob_up") -> DataFrame:
    """Probability threshold per event type that keeps the target coverage."""
    big = rows.groupBy("event_type").agg(F.count(prob).alias("n")).filter(F.col("n") >= min_rows)
    return exact_quantiles(rows, ["event_type"], prob, {"threshold": max(0.0, 1 - coverage)}).join(big, "event_type")


def decide(rows: DataFrame, policy: DataFrame, default: float = 0.5, max_disagreement: float = 0.55) -> DataFrame:
    """Direction, confidence, abstention and reasons from a probability and a type threshold."""
    j = rows.join(policy.select("event_type", F.col("threshold").alias("_t")), "event_type", "left").withColumn("_t", F.coalesce("_t", F.lit(default)))
    conf = F.abs(F.col("prob_up") - 0.5) * 2
    low, clash = F.round(conf, 12) < F.round(F.abs(F.col("_t") - 0.5) * 2, 12), F.col("disagreement") > max_disagreement
    bare = (F.col("n_evidence") == 0) & F.col("has_factors")
    reasons = F.concat_ws(";", F.when(low, "low_confidence"), F.when(clash, "high_disagreement"), F.when(bare, "no_retrieved_evidence"))
    j = j.withColumns({"confidence": conf, "abstain": low | clash, "abstain_reason": reasons})
    return j.withColumn("final_dir", F.when(F.col("abstain"), "0").when(F.col("prob_up") >= 0.5, "+").otherwise("-")).drop("_t")


def forecast_momentum(windows: DataFrame, horizon: int = 5, window: int = 20) -> DataFrame:
    """Flat path from the last returns' sum; variance of the input; logistic probability."""
    x = F.col("x")
    last = total(F.slice(x, F.greatest(F.size(x) - window + 1, F.lit(1)), F.lit(window)))
    step = last / max(horizon, 1)
    df = windows.withColumn("_step", step).withColumn("_mu", mean(x))
    return df.withColumns({"mean": F.array_repeat("_step", horizon), "var": variance(x, F.col("_mu"), 0) + 1e-8, "signal": F.col("_step"),
                           "prob_up": 1 / (1 + F.exp(-3.0 * F.col("_step")))}).drop("_step", "_mu")


def _fit_steps(train: DataFrame, test: DataFrame, horizon: int, make) -> DataFrame:
    """One regressor per output step over all windows; the data stay distributed."""
    tr = cut(train.select(array_to_vector("x").alias("_f"), "y"))
    out = test.withColumn("_f", array_to_vector("x"))
    for k in range(horizon):
        m = make(f"_p{k}").fit(tr.withColumn("_y", F.col("y")[k]))
        out = m.transform(out)
    out = out.withColumn("mean", F.array(*[F.col(f"_p{k}") for k in range(horizon)])).withColumn("_mu", mean(F.col("x")))
    out = out.withColumns({"var": variance(F.col("x"), F.col("_mu"), 0) + 1e-8, "signal": mean(F.col("mean"))})
    prob = 1 / (1 + F.exp(-3.0 * F.col("signal") / F.greatest(F.sqrt("var"), F.lit(1e-6))))
    return out.withColumn("prob_up", prob).drop("_f", "_mu", *[f"_p{k}" for k in range(horizon)])


def forecast_ridge(train: DataFrame, test: DataFrame, horizon: int = 5, alpha: float = 1.0) -> DataFrame:
    """Ridge on flattened windows; Spark averages the loss, so alpha is divided by the row count."""
    n = train.count()
    return _fit_steps(train, test, horizon, lambda p: LinearRegression(
        featuresCol="_f", labelCol="_y", predictionCol=p, regParam=alpha / max(n, 1), elasticNetParam=0.0, standardization=False, solver="normal"))


def forecast_gbt(train: DataFrame, test: DataFrame, horizon: int = 5, rounds: int = 120, max_train: int = 50_000) -> DataFrame:
    """Boosted trees on flattened windows, one model for each output step, fitted side by side.

    Each fit is one task over at most max_train windows (those of the smallest hash, so all of them in smaller
    tables); the models have a fixed size and score every window where it lies.
    """
    drawn = cut(train.select("x", F.slice("y", 1, horizon).alias("y")).orderBy(F.xxhash64("x", "y"), "x").limit(max_train))
    steps = drawn.select("x", F.posexplode("y").alias("step", "t"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = boost(np.stack(pdf["x"].to_numpy()), pdf["t"].to_numpy(float), False, rounds, 3, 0.05, 0.8, 0.8, 1.0, 1)
        return pd.DataFrame({"step": [pdf["step"].iloc[0]], "model": [m.pack()]})

    models = {r.step: r.model for r in steps.groupBy("step").applyInPandas(fit, "step int, model binary").collect()}
    held = test.sparkSession.sparkContext.broadcast([models[k] for k in sorted(models)])

    @F.pandas_udf("array<double>")
    def score(xs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees = [Trees.unpack(m) for m in held.value]
        for x in xs:
            v = np.stack(x.to_numpy()) if len(x) else np.empty((0, 1))
            yield pd.Series(list(np.stack([t.scores(v) for t in trees], axis=1)) if len(x) else [], dtype=object)

    out = test.withColumn("mean", score("x")).withColumn("_mu", mean(F.col("x")))
    out = out.withColumns({"var": variance(F.col("x"), F.col("_mu"), 0) + 1e-8, "signal": mean(F.col("mean"))})
    prob = 1 / (1 + F.exp(-3.0 * F.col("signal") / F.greatest(F.sqrt("var"), F.lit(1e-6))))
    return out.withColumn("prob_up", prob).drop("_mu")


def forecast_pool(windows: DataFrame, horizon: int = 5, rounds: int = 120) -> DataFrame:
    """Candidate forecasts of every window: momentum, and ridge and boosted trees fitted on the training windows (is_train)."""
    w = windows.withColumn("is_val", ~F.col("is_train"))
    train = w.filter("is_train")
    made = {"momentum": forecast_momentum(w, horizon), "linear": forecast_ridge(train, w, horizon), "trees": forecast_gbt(train, w, horizon, rounds)}
    out = None
    for name, df in made.items():
        one = df.withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def temporal_split(windows: DataFrame, share: float = 0.8) -> DataFrame:
    """Mark the first share of each series' windows as training."""
    w = Window.partitionBy("industry_code")
    rn = F.row_number().over(w.orderBy("start_d"))
    return windows.withColumn("is_train", rn <= F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share)))


def pool_select(preds: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Inverse-loss mixture of candidate forecasts (model, mean array, var, prob_up, signal, y, is_val).

    Losses come from validation rows; the best model is the lowest loss by name.
    """
    ae = total(F.zip_with("mean", "y", lambda a, b: F.abs(a - b)))
    loss = preds.filter("is_val").groupBy(*by, "model").agg((F.sum(ae) / F.sum(F.size("y"))).alias("loss"))
    w = Window.partitionBy(*by)
    inv = 1 / F.greatest("loss", F.lit(1e-6))
    weights = loss.select(*by, "model", "loss", (inv / F.sum(inv).over(w)).alias("weight"), F.min_by("model", F.struct("loss", "model")).over(w).alias("selected"))
    j = preds.join(weights, [*by, "model"])
    step = F.posexplode("mean").alias("step", "m")
    path = j.select(*keys, "weight", step).groupBy(*keys, "step").agg(F.sum(F.col("m") * F.col("weight")).alias("m"))
    path = path.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("step", "m"))).alias("_p")).select(*keys, F.col("_p.m").alias("mean"))
    mix = j.groupBy(*keys).agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("var", "prob_up", "signal")], F.first("selected").alias("selected"), F.count("*").alias("n_models"))
    return mix.join(path, list(keys))


def conformal_factors(paths: DataFrame, by: Sequence[str], levels: dict[str, float] = {"80": 0.80, "95": 0.95}) -> DataFrame:
    """Interval scale per group: quantile of |residual| / half width, kept within [.5, 5]."""
    out = None
    for k, q in levels.items():
        s = F.abs(F.col("actual") - F.col("mean")) / ((F.col(f"upper_{k}") - F.col(f"lower_{k}")) / 2 + 1e-8)
        one = exact_quantiles(paths.select(*by, s.alias("_s")), by, "_s", {"q": q}).select(*by, clip("q", 0.5, 5).alias(f"factor_{k}"))
        out = one if out is None else out.join(one, list(by))
    return out


def rescale_interval(paths: DataFrame, factors: DataFrame, by: Sequence[str], strength: Column, base: float = 1.25, boost: float = 1.5, start: float = 0.05) -> DataFrame:
    """Widen both intervals about their midpoint: factor, base scale, event boost."""
    s = F.abs(strength)
    scale = base * F.when(s > start, 1 + F.least(s, F.lit(1.0)) * (boost - 1)).otherwise(1.0)
    j = paths.join(factors, list(by), "left").withColumn("_sc", scale)
    for k in ("80", "95"):
        mid, half = (F.col(f"lower_{k}") + F.col(f"upper_{k}")) / 2, (F.col(f"upper_{k}") - F.col(f"lower_{k}")) / 2
        h = half * F.coalesce(F.col(f"factor_{k}"), F.lit(1.0)) * F.col("_sc")
        j = j.withColumns({f"lower_{k}": mid - h, f"upper_{k}": mid + h})
    return j.drop("_sc", "factor_80", "factor_95")


def align_sign(value: Column, prob: Column, deadzone: float = 0.12, min_conf: float = 0.20) -> Column:
    """Give a small forecast the classifier's sign when the two conflict and the classifier is sure."""
    p = clip(prob, 1e-4, 1 - 1e-4)
    conf = F.abs(p - 0.5) * 2
    sign = F.when(p >= 0.5, 1.0).otherwise(-1.0)
    fix = (conf >= min_conf) & (F.abs(value) <= deadzone) & (F.when(value >= 0, 1.0).otherwise(-1.0) != sign)
    return F.when(fix, sign * F.greatest(F.abs(value), deadzone * (0.5 + 0.5 * conf))).otherwise(value)


def baseline_majority(rows: DataFrame) -> DataFrame:
    """Majority direction of strictly earlier rows; the overall majority where there are none."""
    up = (F.col("real_dir") == "+").cast("long")
    past = past_totals(rows, [], "event_date", {"n": F.lit(1), "u": up})
    glob = rows.agg(F.avg(up) >= 0.5).scalar()
    j = rows.join(settled(past), "event_date")
    call = F.when(F.col("n") == 0, glob).otherwise(2 * F.col("u") >= F.col("n"))
    return j.withColumn("b1", F.when(call, "+").otherwise("-")).drop("n", "u")


def baseline_type_prior(rows: DataFrame, min_rows: int = 3) -> DataFrame:
    """Majority of earlier rows of the same type, else the overall baseline."""
    up = (F.col("real_dir") == "+").cast("long")
    past = past_totals(rows, ["event_type"], "event_date", {"n": F.lit(1), "u": up})
    j = baseline_majority(rows).join(past, ["event_type", "event_date"])
    return j.withColumn("b2", F.when(F.col("n") >= min_rows, F.when(2 * F.col("u") >= F.col("n"), "+").otherwise("-")).otherwise(F.col("b1"))).drop("n", "u")


def baseline_momentum(rows: DataFrame, rel: str = "rel_r20") -> DataFrame:
    return rows.withColumn("b3", F.when(F.coalesce(rel, F.lit(0.0)) >= 0, "+").otherwise("-"))


def _stacked(values: Sequence) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in values])


def expanding_fits(rows: DataFrame, date: str, order: Sequence[str], fit, max_train: int, min_rows: int, chunk: int = 16, decode=_stacked) -> DataFrame:
    """(_day, model): decode(values of x) gives a matrix and fit([(x, y), ...]) one model for each set, which holds the last max_train of the rows (x, _y, date, order) strictly before every date.

    Runs of `chunk` dates share a task, which holds the last max_train rows before the run and at most max_train
    of each of its dates, sorted once; each date reads its prefix, and the run's fits go on together. Dates with fewer than min_rows earlier rows, or
    rows of one direction only, get no model.
    """
    days = rows.select(date).distinct().withColumn("_chunk", F.floor((F.row_number().over(Window.orderBy(date)) - 1) / chunk).cast("int"))
    base = rows.join(F.broadcast(days), date)
    late = training_blocks(base, date, "_chunk", order, max_train).select("_x", "_y", date, *order, F.col("fit_block").alias("_chunk"))
    last = Window.partitionBy(date).orderBy(*[F.desc(c) for c in order])
    own = base.withColumn("_k", F.row_number().over(last)).filter(F.col("_k") <= max_train).select("_x", "_y", date, *order, "_chunk")
    held = late.withColumn("_own", F.lit(False)).unionByName(own.withColumn("_own", F.lit(True))).withColumn("_day", F.unix_date(F.col(date).cast("date")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_day", *order], kind="stable")
        x, y, day = decode(pdf["_x"]), pdf["_y"].to_numpy(float), pdf["_day"].to_numpy()
        ends = {int(d): int(np.searchsorted(day, d)) for d in np.unique(day[pdf["_own"].to_numpy()])}
        parts = {d: slice(max(0, n - max_train), n) for d, n in ends.items() if n >= min_rows}
        parts = {d: p for d, p in parts.items() if 0 < y[p].sum() < len(y[p])}
        return pd.DataFrame({"_day": list(parts), "model": fit([(x[p], y[p]) for p in parts.values()]) if parts else []})

    fitted = held.groupBy("_chunk").applyInPandas(run, "_day int, model binary")
    return fitted.select(F.date_from_unix_date("_day").alias("_day"), "model")


def scored_by_date(rows: DataFrame, models: DataFrame, date: str, score, slice_rows: int = 10_000, decode=_stacked) -> DataFrame:
    """rows (with _x) and the column z: score(model, x) by the model of the row's date, null without one.

    A date's rows meet its model in slices of about slice_rows rows.
    """
    counts = rows.groupBy(F.col(date).cast("date").alias("_day")).agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("_n"))
    sliced = rows.withColumn("_day", F.col(date).cast("date")).join(counts, "_day").withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.col("_n")).cast("int")).drop("_n")
    placed = models.join(counts, "_day").select("_day", "model", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_s"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        z = score(right.column("model")[0].as_py(), decode(left.column("_x").to_pylist())) if right.num_rows and left.num_rows else None
        return left.drop_columns(["_day", "_s"]).append_column("z", pa.array(z, type=pa.float64()) if z is not None else pa.nulls(left.num_rows, pa.float64()))

    shape = rows.withColumn("z", F.lit(None).cast("double")).schema
    return sliced.groupBy("_day", "_s").cogroup(placed.groupBy("_day", "_s")).applyInArrow(run, shape)


def expanding_scores(alike: DataFrame, day: str, fit, score, min_rows: int, chunk: int = 16, batch: int = 1 << 15) -> DataFrame:
    """(day, _x, z): the score of a date's features by a fit on all rows strictly before that date.

    alike holds a row for each date and distinct _x, with its numbers of rows by direction (_up, _down) and the first of them in
    order (_first). fit([(x, y, counts), ...]) gives one model for each set, score(model, x) the scores. Runs of `chunk` dates
    share a task, which holds each distinct _x before the run once and those of its own dates: a task and the shuffle grow with
    distinct features, not with rows. About `batch` rows are fitted at a time. Dates with fewer than min_rows earlier rows, or
    rows of one direction only, get no score.
    """
    days = alike.select(day).distinct().withColumn("_chunk", F.floor((F.row_number().over(Window.orderBy(day)) - 1) / chunk).cast("int"))
    own = alike.join(F.broadcast(days), day)
    runs = days.agg(F.max("_chunk")).first()[0]
    runs = 1 if runs is None else runs + 1
    ones = [F.sum("_up").alias("_up"), F.sum("_down").alias("_down"), F.min("_first").alias("_first")]
    past = own.groupBy("_chunk", "_x").agg(*ones).filter(F.col("_chunk") < runs - 1)
    past = past.withColumn("_chunk", F.explode(F.sequence(F.col("_chunk") + 1, F.lit(runs - 1)))).groupBy("_chunk", "_x").agg(*ones)
    held = past.withColumn(day, F.lit(None).cast("date")).unionByName(own)
    order = [f"_o{i}" for i in range(len(alike.schema["_first"].dataType.names))]
    held = held.select("_chunk", F.unix_date(day).alias("_day"), "_x", "_up", "_down", *[F.col("_first")[n].alias(c) for c, n in zip(order, alike.schema["_first"].dataType.names, strict=True)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # features in the order of their first row: those known before a date come first
        x = _stacked(pdf["_x"])
        at = np.lexsort(x.T)
        at = at[pdf[order].iloc[at].reset_index(drop=True).sort_values(order, kind="stable").index]
        x, day_of, counts = x[at], pdf["_day"].to_numpy(float)[at], pdf[["_up", "_down"]].to_numpy(float)[at]
        _, begin, of = np.unique(x, axis=0, return_index=True, return_inverse=True)
        rank = np.argsort(begin)
        kind, known = np.argsort(rank)[of.ravel()], x[np.sort(begin)]
        seen = np.zeros((len(known), 2))
        np.add.at(seen, kind[np.isnan(day_of)], counts[np.isnan(day_of)])
        out, sets = [], []

        def flush() -> None:
            out.extend(pd.DataFrame({"_day": d, "_x": list(v), "z": score(m, v)}) for m, (_, d, v) in zip(fit([s for s, _, _ in sets]), sets, strict=True))
            sets.clear()

        for d in np.unique(day_of[~np.isnan(day_of)]):
            mine = day_of == d
            if seen.sum() >= min_rows and (seen.sum(axis=0) > 0).all():
                who, down = np.nonzero(seen)
                sets.append(((known[who], 1.0 - down, seen[who, down]), int(d), x[mine]))
                if sum(len(s[1]) for s, _, _ in sets) >= batch:
                    flush()
            np.add.at(seen, kind[mine], counts[mine])
        if sets:
            flush()
        return pd.concat(out) if out else pd.DataFrame({"_day": [], "_x": [], "z": []}, dtype=object)

    scored = held.repartition(runs, "_chunk").groupBy("_chunk").applyInPandas(run, "_day int, _x array<double>, z double")
    return scored.select(F.date_from_unix_date("_day").alias(day), "_x", "z")


def logistic_fit(x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Ridge logistic (weight 1 against the summed loss) of standardised features by Newton steps: means, scales, coefficients.

    counts: how many rows each row of x stands for.
    """
    c = np.ones(len(y)) if counts is None else counts
    mu = x.mean(axis=0) if counts is None else c @ x / c.sum()
    sd = x.std(axis=0) if counts is None else np.where(np.ptp(x, axis=0) > 0, np.sqrt(c @ (x - mu) ** 2 / c.sum()), 0.0)
    sd = np.where(sd > 0, sd, 1.0)
    a = np.hstack([(x - mu) / sd, np.ones((len(x), 1))])
    pen = np.eye(a.shape[1])
    pen[-1, -1] = 1e-9
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (c * p * (1 - p))[:, None]).T @ a + pen, a.T @ (c * (p - y)) + pen @ b)
        b -= step
        if np.abs(step).max() < 1e-10:
            break
    return np.concatenate([mu, sd, b]).tobytes()


def logistic_score(model: bytes, x: np.ndarray) -> np.ndarray:
    v, m = np.frombuffer(model), x.shape[1]
    return (x - v[:m]) / v[m:2 * m] @ v[2 * m:-1] + v[-1]


def baseline_ml(rows: DataFrame, features: Sequence[str], kind: str, date: str = "event_date", order: Sequence[str] = ("event_id",), rounds: int = 120, min_rows: int = 20,
                max_train: int | None = None) -> DataFrame:
    """Logistic ("logistic") or boosted-tree ("gbt") classifier of the features, refitted at every date on earlier rows.

    `pred` is '+' or '-'. A fit takes all earlier rows with all features and a direction, or the last max_train of them. Rows without features
    and dates without a fit (fewer than min_rows earlier rows, one direction only) take the majority baseline.
    """
    base = baseline_majority(rows).withColumns({"_y": (F.col("real_dir") == "+").cast("double"), "_x": F.array(*[F.col(c).cast("double") for c in features])})
    usable = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v))
    trees = lambda sets: [t.pack() for t in boost_all(sets, True, rounds, 4, 0.05, 0.9, 0.9, 0.0, 5)]
    lines = lambda sets: [logistic_fit(*s) for s in sets]
    fit, score = (lines, logistic_score) if kind == "logistic" else (trees, lambda m, x: Trees.unpack(m).scores(x))
    # a score hangs on date and features alone: rows that share them are scored once
    if max_train is None:
        base = base.withColumn("_day", F.col(date).cast("date"))
        first = F.min(F.struct(date, *[c for c in order if c != date]))
        alike = base.filter(usable & F.col("_day").isNotNull()).groupBy("_day", "_x").agg(F.count_if(F.col("_y") == 1).alias("_up"), F.count_if(F.col("_y") == 0).alias("_down"), first.alias("_first"))
        out = base.join(settled(expanding_scores(cut(alike), "_day", fit, score, min_rows)), ["_day", "_x"], "left")
    else:
        base = cut(base)
        whole = base.filter(usable)
        models = expanding_fits(whole.select("_x", "_y", date, *order), date, order, fit, max_train, min_rows)
        scored = settled(scored_by_date(whole.select(date, "_x").distinct(), cut(models), date, score))
        out = base.join(scored, [date, "_x"], "left")
    return out.select(*rows.columns, F.when(F.col("z").isNull(), F.col("b1")).when(F.col("z") > 0, "+").otherwise("-").alias("pred"))


def char_ngrams(word: str, lo: int = 2, hi: int = 4) -> list[str]:
    """Character n-grams of a word padded by a blank on both sides; a shorter padded word is its own gram."""
    w = f" {word} "
    return [w[i:i + n] for n in range(lo, hi + 1) for i in range(max(len(w) - n + 1, 1))]


def hashed_grams(n_features: int):
    """Function of texts: hashed n-gram counts of each as bytes, feature numbers then counts, four bytes each."""
    known: dict[str, np.ndarray] = {}

    def ids(word: str) -> np.ndarray:
        if word not in known:
            if len(known) >= 1 << 16:
                known.clear()
            known[word] = np.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) % n_features for g in char_ngrams(word)], dtype=np.int64)
        return known[word]

    def count(text: str | None) -> bytes:
        words = (text or "").lower().split()
        total = np.zeros(n_features, dtype=np.uint32)
        for i in range(0, len(words), 4096):
            total += np.bincount(np.concatenate([ids(w) for w in words[i:i + 4096]]), minlength=n_features).astype(np.uint32)
        at = np.flatnonzero(total).astype(np.uint32)
        return np.concatenate([at, total[at]]).tobytes()

    return count


def text_logistic_fits(sets: list[tuple[np.ndarray, np.ndarray]], tolerance: float = 1e-7) -> list[bytes]:
    """Ridge logistic fits (weight 1 against the summed loss) of counts times the set's own inverse document frequencies.

    Newton steps by conjugate gradients on the counts, each set started from the fit of the one before it; the optimum
    is unique, so the start only saves steps. A model holds the weights of counts and the intercept.
    """
    out, b = [], None
    for x, y in sets:
        idf = np.append(np.log((len(y) + 1) / ((x > 0).sum(axis=0) + 1.0)), 1.0)
        pen = np.append(np.ones(x.shape[1]), 0.0)
        b = np.zeros(len(pen)) if b is None else b
        margin = lambda v: x @ (idf[:-1] * v[:-1]) + v[-1]  # noqa: B023, E731
        back = lambda r: np.append(idf[:-1] * (r @ x), r.sum())  # noqa: B023, E731
        loss = lambda v, z: np.logaddexp(0, z).sum() - y @ z + 0.5 * (pen * v * v).sum()  # noqa: B023, E731
        z = margin(b)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            g = back(p - y) + pen * b
            if np.abs(g).max() < tolerance:
                break
            h = np.maximum(p * (1 - p), 1e-12)
            step, r = np.zeros(len(b)), -g
            d, rr = r.copy(), r @ r
            goal = rr * min(0.1, rr**0.25) ** 2
            for _ in range(200):
                hd = back(h * margin(d)) + pen * d
                a = rr / (d @ hd)
                step, r = step + a * d, r - a * hd
                new = r @ r
                if new <= goal:
                    break
                d, rr = r + new / rr * d, new
            size, now, dz = 1.0, loss(b, z), margin(step)
            while size > 1e-6 and loss(b + size * step, z + size * dz) > now + 1e-12 * abs(now):
                size /= 2
            b, z = b + size * step, z + size * dz
        out.append((idf * b).tobytes())
    return out


def baseline_text(rows: DataFrame, date: str = "event_date", order: Sequence[str] = ("doc_id",), text: str = "text", n_features: int = 4096, min_rows: int = 20,
                  max_train: int = 1_000) -> DataFrame:
    """Character n-gram TF-IDF and a logistic classifier, refitted at every date on the last max_train earlier rows; `pred` is '+' or '-'.

    Counts are hashed once in one pass over the texts; inverse frequencies belong to each fit, so they hold earlier
    texts only. Dates without a fit (fewer than min_rows earlier rows, one direction only) take the majority baseline.
    A null text is empty.
    """
    def dense(values: Sequence) -> np.ndarray:
        x = np.zeros((len(values), n_features))
        for i, v in enumerate(values):
            v = np.frombuffer(v, dtype=np.uint32)
            x[i, v[: len(v) // 2]] = v[len(v) // 2:]
        return x

    @F.pandas_udf("binary")
    def counts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = hashed_grams(n_features)
        for p in parts:
            yield p.map(count) if len(p) else pd.Series([], dtype=object)

    base = baseline_majority(rows).withColumns({"_y": (F.col("real_dir") == "+").cast("double"), "_x": counts(F.coalesce(F.col(text), F.lit("")))})
    base = cut(base.select(date, *[c for c in order if c != date], "b1", "_y", "_x", *[c for c in rows.columns if c not in {date, *order}]))
    models = cut(expanding_fits(base.select("_x", "_y", date, *order), date, order, text_logistic_fits, max_train, min_rows, 32, dense))
    scored = scored_by_date(base, models, date, lambda m, x: x @ np.frombuffer(m)[:-1] + np.frombuffer(m)[-1], 1_000, dense)
    return scored.select(*rows.columns, F.when(F.col("z").isNull(), F.col("b1")).when(F.col("z") > 0, "+").otherwise("-").alias("pred"))


def _grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def text_features(docs: DataFrame, key: str, text: str = "text", n_terms: int = 128, top: int = 16, held: int = 1 << 18) -> DataFrame:
    """Weights of a text's strongest terms: 1-2 grams, the n_terms most frequent terms, smoothed idf, unit length.

    One pass counts terms and their documents in each task, sending on at most about `held` distinct terms at a time; a
    second one looks up the n_terms of the vocabulary in each text. Nothing is shuffled by document. A null text has no terms.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    rows = spread(docs.select(key, text)).select(key, F.coalesce(words, F.array().cast("array<string>")).alias("_w"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, docs_with = Counter(), Counter()
        send = lambda: pa.RecordBatch.from_arrays([pa.array(list(every)), pa.array(list(every.values()), pa.int64()), pa.array([docs_with[t] for t in every], pa.int64())], ["term", "c", "d"])
        for b in parts:
            for w in b.column(0).to_pylist():
                terms = Counter(_grams(w))
                every.update(terms)
                docs_with.update(terms.keys())
                if len(every) > held:
                    yield send()
                    every.clear()
                    docs_with.clear()
        if every:
            yield send()

    n = docs.count()
    counts = rows.select("_w").mapInArrow(count, "term string, c long, d long").groupBy("term").agg(F.sum("c").alias("ctf"), F.sum("d").alias("df"))
    vocab = counts.orderBy(F.desc("ctf"), "term").limit(n_terms).select("term", (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).collect()
    shared = docs.sparkSession.sparkContext.broadcast({r.term: r.idf for r in vocab})

    def weigh(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for b in parts:
            at, rank, term, weight = [], [], [], []
            for i, w in enumerate(b.column(1).to_pylist()):
                found = [(t, c * idf[t]) for t, c in sorted(Counter(g for g in _grams(w) if g in idf).items())]
                norm = math.sqrt(sum(v * v for _, v in found))
                best = sorted((-round(v / norm, 12), t) for t, v in found)[:top]
                at += [i] * len(best)
                rank += range(1, len(best) + 1)
                term += [t for _, t in best]
                weight += [-v for v, _ in best]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()), pa.array(term, pa.string()), pa.array(weight, pa.float64())], [key, "rank", "term", "weight"])

    return rows.mapInArrow(weigh, f"`{key}` {dict(docs.dtypes)[key]}, rank int, term string, weight double")
