"""Ensembling and evaluation of predictions, with bootstraps from value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.functions.ordered import ordered_rank
from evq.functions.resample import interval, multinomial_sums, resample_rows

KEYS = ("event_id", "event_date", "industry_code")


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def forced(types: Sequence[str] | None, fragments: Sequence[str] | None, name: str = "event_name") -> Column:
    out = F.lit(False)
    if types:
        out = out | F.col("event_type").isin(list(types))
    for f in fragments or ():
        out = out | F.coalesce(F.col(name).contains(f), F.lit(False))
    return out


def ensemble(a: DataFrame, b: DataFrame, weights: Sequence[float] = (0.5, 0.5), threshold: float = 0.12,
             abstain_types: Sequence[str] | None = None, abstain_names: Sequence[str] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weighted mean of two probabilities on aligned rows, with threshold and forced abstention."""
    wa = float(weights[0]) / (weights[0] + weights[1])
    j = a.join(b.select(*keys, F.col("prob_up").alias("_pb")), list(keys))
    p = wa * F.col("prob_up") + (1 - wa) * F.col("_pb")
    j = j.withColumn("prob_up", p).drop("_pb").withColumn("confidence", F.abs(F.col("prob_up") - 0.5) * 2)
    j = j.withColumns({"abstain": (F.col("confidence") < threshold) | forced(abstain_types, abstain_names),
                       "final_dir": F.when(F.col("prob_up") >= 0.5, "+").otherwise("-")})
    j = j.withColumn("dir_correct", F.col("final_dir") == F.col("real_dir"))
    return j.withColumn("committed_dir_correct", ~F.col("abstain") & F.col("dir_correct"))


def threshold_scan(rows: DataFrame, thresholds: Sequence[float] | None = None, abstain: Column | None = None) -> DataFrame:
    """Accuracy and coverage at each threshold from one grouped pass.

    Each row lands in the bucket of the highest threshold it passes; suffix sums over
    the few buckets replace a rows-by-grid product.
    """
    ts = sorted(thresholds if thresholds is not None else [round(0.025 * i, 3) for i in range(21)])
    ok = ~abstain if abstain is not None else F.lit(True)
    passed = sum((F.when(ok & (F.col("confidence") >= t), 1).otherwise(0) for t in ts), F.lit(0))
    g = rows.groupBy(passed.alias("k")).agg(F.count("*").alias("n"), F.sum(F.col("dir_correct").cast("long")).alias("c"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ts)]))
    z = g.select("k", "n", "c", grid.alias("g")).groupBy("g.threshold").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum(F.when(F.col("k") > F.col("g.i"), F.col("n")).otherwise(0)).alias("cn"),
        F.sum(F.when(F.col("k") > F.col("g.i"), F.col("c")).otherwise(0)).alias("cc"))
    return z.select("threshold", (F.col("c") / F.col("n")).alias("full_accuracy"), (F.col("cn") / F.col("n")).alias("coverage"),
                    F.try_divide(F.col("cc"), F.col("cn")).alias("committed_accuracy"))


def walk_forward_ensemble(a: DataFrame, b: DataFrame, weights: Sequence[float] = (0.2, 0.4, 0.5, 0.6, 0.8),
                          thresholds: Sequence[float] = (0.05, 0.10, 0.12, 0.15, 0.20), abstain_types: Sequence[str] | None = None,
                          min_rows: int = 20, min_committed: int = 5, default: tuple[float, float] = (0.6, 0.12), keys: Sequence[str] = KEYS) -> DataFrame:
    """Weight and threshold chosen from strictly earlier dates only.

    Per date and weight the rows are counted by threshold bucket in one pass (one small
    struct per date), accumulated over dates, and the best grid cell is joined back.
    """
    j = a.join(b.select(*keys, F.col("prob_up").alias("prob_b")), list(keys))
    off = forced(abstain_types, None)

    def conf(w):
        return F.round(F.abs(F.lit(w) * F.col("prob_up") + F.lit(1.0 - w) * F.col("prob_b") - 0.5) * 2, 12)

    def hit(w):
        up = F.round(F.lit(w) * F.col("prob_up") + F.lit(1.0 - w) * F.col("prob_b"), 12) >= 0.5
        return F.col("real_dir") == F.when(up, "+").otherwise("-")

    cells = [(w, t) for w in weights for t in thresholds]
    aggs = [F.count("*").alias("n")]
    for i, (w, t) in enumerate(cells):
        in_ = ~off & (conf(w) >= t)
        aggs += [F.sum(in_.cast("long")).alias(f"m{i}"), F.sum((in_ & hit(w)).cast("long")).alias(f"c{i}")]
    daily = j.groupBy("event_date").agg(*aggs)
    past = Window.orderBy("event_date").rowsBetween(Window.unboundedPreceding, -1)
    cum = daily.select("event_date", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(c) for c in daily.columns[1:]])
    scored = [F.struct(F.when(F.col(f"m{i}") >= min_committed, F.round(F.try_divide(F.col(f"c{i}"), F.col(f"m{i}")) + 0.05 * F.try_divide(F.col(f"m{i}"), F.col("n")), 12)).alias("s"),
                       F.lit(-i).alias("o"), F.lit(w).alias("w"), F.lit(t).alias("t")) for i, (w, t) in enumerate(cells)]
    best = F.array_max(F.filter(F.array(*scored), lambda x: x["s"].isNotNull()))
    pick = cum.select("event_date", F.when(F.col("n") >= min_rows, best).alias("b"))
    pick = pick.select("event_date", F.coalesce("b.w", F.lit(default[0])).alias("weight_a"), F.coalesce("b.t", F.lit(default[1])).alias("threshold"))
    out = j.join(pick, "event_date")
    prob = F.round(F.col("weight_a") * F.col("prob_up") + (1 - F.col("weight_a")) * F.col("prob_b"), 12)
    out = out.withColumn("prob_up", prob).withColumn("confidence", F.abs(F.col("prob_up") - 0.5) * 2)
    out = out.withColumns({"abstain": off | (F.round("confidence", 12) < F.col("threshold")), "final_dir": F.when(F.col("prob_up") >= 0.5, "+").otherwise("-")})
    return out.withColumn("dir_correct", F.col("final_dir") == F.col("real_dir")).drop("prob_b")


def aggregate_seeds(runs: DataFrame, keys: Sequence[str] = KEYS, n_seeds: int | None = None, threshold: float = 0.12) -> DataFrame:
    """Mean probability over seeds; abstain on low confidence or on seeds that disagree in sign."""
    g = runs.groupBy(*keys, "event_type", "real_dir").agg(
        F.avg("prob_up").alias("prob_up"), F.count("*").alias("n_seeds"), F.min(F.col("prob_up") >= 0.5).alias("_lo"), F.max(F.col("prob_up") >= 0.5).alias("_hi"))
    g = g.withColumns({"confidence": F.abs(F.col("prob_up") - 0.5) * 2, "disagree": F.col("_lo") != F.col("_hi")}).drop("_lo", "_hi")
    if n_seeds:
        g = g.filter(F.col("n_seeds") == n_seeds)
    g = g.withColumn("abstain", F.col("disagree") | (F.col("confidence") < threshold))
    return g.withColumn("dir_correct", F.col("real_dir") == F.when(F.col("prob_up") >= 0.5, "+").otherwise("-"))


def majority_vote(runs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Majority direction and correctness over runs; ties count as up and as correct."""
    up = F.sum((F.col("final_dir") == "+").cast("int"))
    return runs.groupBy(*keys, "real_dir").agg(
        F.count("*").alias("n_runs"), F.when(2 * up >= F.count("*"), "+").otherwise("-").alias("vote_dir"),
        (2 * F.sum(F.col("dir_correct").cast("int")) >= F.count("*")).alias("vote_correct"))


def _acc_aggs() -> list[Column]:
    ok, on = F.col("dir_correct").cast("double"), ~F.col("abstain")
    return [F.count("*").alias("n"), F.avg(ok).alias("full_accuracy"), F.sum(on.cast("long")).alias("committed_n"),
            F.avg(F.when(on, ok)).alias("committed_accuracy"), F.avg(on.cast("double")).alias("coverage")]


def seed_summary(runs: DataFrame) -> DataFrame:
    """Mean and population sd over seeds of accuracy, committed accuracy and coverage."""
    per = runs.groupBy("seed").agg(*_acc_aggs())
    cols = ("full_accuracy", "committed_accuracy", "coverage")
    return per.agg(F.count("*").alias("n_seeds"), *[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_pop(c).alias(f"{c}_std") for c in cols])


def seed_gap(runs: DataFrame, base: str) -> DataFrame:
    """Gap of each config to the base config in units of the pooled seed deviation."""
    per = runs.groupBy("config", "seed").agg(F.avg(_d("dir_correct")).alias("a")).groupBy("config").agg(
        F.avg("a").alias("m"), F.stddev_samp("a").alias("s"))
    b = per.filter(F.col("config") == base).select(F.col("m").alias("bm"), F.coalesce("s", F.lit(0.0)).alias("bs"))
    j = per.filter(F.col("config") != base).join(b, F.lit(True))
    pooled = F.sqrt((F.coalesce("s", F.lit(0.0)) ** 2 + F.col("bs") ** 2) / 2)
    return j.select("config", (F.col("m") - F.col("bm")).alias("delta"), F.try_divide(F.abs(F.col("m") - F.col("bm")), pooled).alias("separation"))


def summary(results: DataFrame) -> DataFrame:
    """Accuracy overall, by type and by industry from one grouping-sets pass."""
    g = results.groupingSets([[], ["event_type"], ["industry_code"]], "event_type", "industry_code").agg(
        F.grouping_id().alias("_g"), *_acc_aggs())
    scope = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "event_type").otherwise("industry_code")
    return g.select(scope.alias("scope"), F.coalesce("event_type", "industry_code", F.lit("all")).alias("key"), "n", "full_accuracy",
                    "committed_n", "committed_accuracy", "coverage")


def selective_curve(results: DataFrame, n_bins: int = 10, keys: Sequence[str] = KEYS, correct: str = "dir_correct") -> DataFrame:
    """Accuracy of the most confident rows at each coverage step; ties are ordered by key."""
    order = [F.desc("confidence"), *keys]
    r = ordered_rank(results.select(*keys, "confidence", F.col(correct).cast("int").alias("_c")), [], order, "rn", total="n")
    edges = F.sequence(F.lit(1), F.lit(n_bins))
    # first bin whose edge floor(n*b/bins) reaches the row
    b = F.array_min(F.filter(edges, lambda k: F.floor(F.col("n") * k / n_bins) >= F.col("rn")))
    g = r.groupBy(b.alias("bin"), "n").agg(F.count("*").alias("k"), F.sum("_c").alias("c"), F.min("confidence").alias("m"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = F.sum("k").over(w)
    return g.select("bin", rows.alias("cumulative_rows"), (rows / F.col("n")).alias("coverage"), (F.sum("c").over(w) / rows).alias("accuracy"), F.min("m").over(w).alias("min_confidence"))


def paired_bootstrap(a: DataFrame, b: DataFrame, committed: bool = False, reps: int = 2000, keys: Sequence[str] = KEYS) -> DataFrame:
    """Difference in accuracy b - a with percentile interval and two p-values.

    A row contributes -1, 0 or 1, so the resamples need only three counts.
    """
    j = a.select(*keys, _d("dir_correct").alias("_a"), F.col("abstain").alias("_xa")).join(
        b.select(*keys, _d("dir_correct").alias("_b"), F.col("abstain").alias("_xb")), list(keys))
    if committed:
        j = j.filter(~F.col("_xa") & ~F.col("_xb"))
    counts = j.groupBy((F.col("_b") - F.col("_a")).alias("delta")).agg(F.count("*").alias("n"))
    obs = counts.agg((F.sum(F.col("delta") * F.col("n")) / F.sum("n")).alias("d"), F.sum("n").alias("n")).first()
    if obs["n"] is None:
        raise ValueError("no aligned rows")
    r = multinomial_sums(counts, ["delta"], reps)
    return interval(r, F.col("delta") / F.col("n"), F.lit(float(obs["d"]))).withColumns({"n": F.lit(obs["n"]), "delta": F.lit(float(obs["d"]))})


def bootstrap_ci(rows: DataFrame, value: str, reps: int = 2000, by: Sequence[str] = ()) -> DataFrame:
    """Percentile interval of the mean of a column per group, resampled through its value counts."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, _d(value).alias("v")).agg(F.count("*").alias("n"))
    boot = interval(multinomial_sums(counts, ["v"], reps, by), F.col("v") / F.col("n"), by=by).drop("p_sign")
    seen = counts.groupBy(*by).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("observed"))
    return boot.join(seen, list(by)) if by else boot.join(seen, F.lit(True))


def cluster_table(rows: DataFrame, cluster: str, value: Column) -> DataFrame:
    """Sum and count per cluster with a dense index; clusters are dates, so at most a calendar of them."""
    c = rows.filter(value.isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").cast("double").alias("k"))
    return c.withColumn("idx", (F.row_number().over(Window.orderBy(cluster)) - 1).cast("long"))


def cluster_bootstrap(rows: DataFrame, value: Column, cluster: str = "event_date", reps: int = 2000) -> DataFrame:
    """Resample whole event dates: ratio of sums per replicate, and the macro mean over dates."""
    c = cluster_table(rows, cluster, value)
    o = c.agg(F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("k").alias("k"), F.avg(F.col("s") / F.col("k")).alias("macro")).first()
    r = resample_rows(c.select("idx", "s", "k"), "idx", o["n"], ["s", "k"], reps)
    return interval(r, F.try_divide(F.col("s"), F.col("k"))).withColumns(
        {"observed": F.lit(o["s"] / o["k"]), "macro": F.lit(o["macro"]), "n_clusters": F.lit(o["n"])})


def class_accuracy(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    ok, pos = F.col("dir_correct").cast("double"), F.col("real_dir") == "+"
    return results.groupBy(*by).agg(F.count("*").alias("n"), F.avg(ok).alias("overall"), F.sum(pos.cast("long")).alias("n_pos"),
                                    F.avg(F.when(pos, ok)).alias("pos"), F.avg(F.when(~pos, ok)).alias("neg"))


def leakage_bias(a: DataFrame, b: DataFrame, reps: int = 2000, keys: Sequence[str] = KEYS, cluster: str = "event_date") -> DataFrame:
    """Accuracy gap b - a overall and per true class with date-cluster bootstrap intervals."""
    j = a.select(*keys, "real_dir", _d("dir_correct").alias("_a")).join(b.select(*keys, _d("dir_correct").alias("_b")), list(keys))
    d = F.col("_b") - F.col("_a")
    out = None
    for name, keep in (("overall", F.lit(True)), ("positive", F.col("real_dir") == "+"), ("negative", F.col("real_dir") == "-")):
        one = cluster_bootstrap(j.filter(keep), d, cluster, reps).withColumn("klass", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def factorial_effects(runs: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Marginal effect of each on/off channel from a tag such as '101': mean on minus mean off."""
    cell = runs.groupBy("tag").agg(F.avg(_d("dir_correct")).alias("a"))
    bits = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), (F.substring("tag", i + 1, 1) == "1").alias("on")) for i, c in enumerate(channels)]))
    g = cell.select("a", bits.alias("b")).groupBy("b.channel").agg(F.avg(F.when(F.col("b.on"), F.col("a"))).alias("on_mean"), F.avg(F.when(~F.col("b.on"), F.col("a"))).alias("off_mean"))
    return g.select("channel", "on_mean", "off_mean", (F.col("on_mean") - F.col("off_mean")).alias("effect"))


def noise_band(runs: DataFrame) -> DataFrame:
    per = runs.groupBy("config", "seed").agg(F.avg(_d("dir_correct")).alias("a"))
    return per.groupBy("config").agg(F.count("*").alias("n_runs"), F.avg("a").alias("mean"), F.stddev_samp("a").alias("sd"), F.min("a").alias("lo"), F.max("a").alias("hi"))


def pairwise_agreement(runs: DataFrame, keys: Sequence[str] = KEYS, error: str | None = None) -> DataFrame:
    """Share of equal directions between runs, and mean absolute gap of an error column.

    Runs are gathered per scenario as one short array (one entry per run), so pairs form
    inside a row instead of a self join.
    """
    item = F.struct("run", "final_dir", *( [F.col(error).alias("e")] if error else []))
    g = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("r"))
    pairs = F.flatten(F.transform("r", lambda x: F.transform(F.filter("r", lambda y: y["run"] > x["run"]), lambda y: F.struct(
        x["run"].alias("a"), y["run"].alias("b"), (x["final_dir"] == y["final_dir"]).alias("same"),
        (F.abs(x["e"] - y["e"]) if error else F.lit(None).cast("double")).alias("gap")))))
    return g.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("run_a"), F.col("p.b").alias("run_b")).agg(
        F.count("*").alias("n"), F.avg(_d("p.same")).alias("agreement"), F.avg("p.gap").alias("mean_gap"))


def flip_table(runs: DataFrame, base: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    j = runs.join(base.select(*keys, F.col("dir_correct").alias("_b")), list(keys))
    fixed, broke = F.count_if(F.col("dir_correct") & ~F.col("_b")), F.count_if(~F.col("dir_correct") & F.col("_b"))
    return j.groupBy("config").agg(F.count("*").alias("n"), fixed.alias("wrong_to_right"), broke.alias("right_to_wrong"), (fixed - broke).alias("net"))


def cost_weighted(results: DataFrame, by: Sequence[str] = (), fp_cost: float = 8.0) -> DataFrame:
    fp = F.count_if((F.col("final_dir") == "+") & (F.col("real_dir") == "-"))
    fn = F.count_if((F.col("final_dir") == "-") & (F.col("real_dir") == "+"))
    return results.groupBy(*by).agg(fp.alias("fp"), fn.alias("fn"), (fp * fp_cost + fn).alias("cost"), ((fp * fp_cost + fn) / F.count("*")).alias("cost_per_row"))


def subset_accuracy(results: DataFrame, subsets: dict[str, Sequence[str]]) -> DataFrame:
    """Accuracy after dropping the event types each named subset lists."""
    names = F.array(*[F.when(~F.col("event_type").isin(list(t)) if t else F.lit(True), F.lit(n)) for n, t in subsets.items()])
    return results.select("dir_correct", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("subset")).groupBy("subset").agg(
        F.count("*").alias("n"), F.avg(_d("dir_correct")).alias("accuracy"))


def ablation_table(runs: DataFrame, full: str) -> DataFrame:
    """Accuracy by config, config x type and config x direction, with the drop against the full config."""
    g = runs.groupingSets([["config"], ["config", "event_type"], ["config", "real_dir"]], "config", "event_type", "real_dir").agg(
        F.count("*").alias("n"), F.avg(_d("dir_correct")).alias("accuracy"))
    g = g.select("config", F.coalesce("event_type", "real_dir", F.lit("all")).alias("slice"), "n", "accuracy")
    base = g.filter(F.col("config") == full).select("slice", F.col("accuracy").alias("_f"))
    return g.join(base, "slice", "left").withColumn("drop_vs_full", F.col("_f") - F.col("accuracy")).drop("_f")


def by_year(results: DataFrame, split_year: int) -> DataFrame:
    """Accuracy per year and side, with the out-of-time minus in-time gap on every row."""
    y = results.withColumn("year", F.year("event_date"))
    g = y.groupBy("year").agg(F.count("*").alias("n"), F.sum(_d("dir_correct")).alias("_c"))
    out = F.col("year") > split_year
    w = Window.partitionBy()
    gap = F.try_divide(F.sum(F.when(out, F.col("_c"))).over(w), F.sum(F.when(out, F.col("n"))).over(w)) - F.try_divide(
        F.sum(F.when(~out, F.col("_c"))).over(w), F.sum(F.when(~out, F.col("n"))).over(w))
    return g.select("year", "n", (F.col("_c") / F.col("n")).alias("accuracy"), out.alias("out_of_time"), gap.alias("oot_gap"))
