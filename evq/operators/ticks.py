"""Market ticks: assembly, shocks, leaders, derived edges, residual monitor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ticks(rets: DataFrame, flow: DataFrame | None = None) -> DataFrame:
    """One row per date: market return, industry returns as a map, flow change.

    A date holds one value per industry, so the map is bounded by the industries.
    """
    pair = F.struct("industry_code", "r")
    g = rets.filter("r is not null").groupBy(F.col("d").alias("date")).agg(
        F.max("m").alias("market_return"), F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("industry_returns"))
    if flow is None:
        return g.withColumn("margin_change", F.lit(None).cast("double"))
    return g.join(flow.select(F.col("d").alias("date"), "margin_change"), "date", "full")


def margin_change(margin: DataFrame) -> DataFrame:
    w = Window.orderBy("d")
    return margin.select("d", (F.try_divide(F.col("total_fin"), F.lag("total_fin").over(w)) - 1).alias("margin_change"))


def detect_shocks(t: DataFrame, market: float = 0.02, industry: float = 0.04, margin: float = 0.03, most: int = 5) -> DataFrame:
    """Reason text of a tick: market move, the first extreme industries, margin change. Row-wise, so also for streams."""
    def fmt(c):
        return F.format_string("%+.4f", c)

    far = F.filter(F.map_entries("industry_returns"), lambda e: F.abs(e["value"]) >= industry)
    names = F.transform(F.slice(far, 1, most), lambda e: F.concat(e["key"], F.lit(":"), F.format_string("%+.4f", e["value"])))
    parts = [F.when(F.abs("market_return") >= market, F.concat(F.lit("market_move="), fmt(F.col("market_return")))),
             F.when(F.size(far) > 0, F.concat(F.lit("industry_move="), F.array_join(names, ","))),
             F.when(F.abs(F.coalesce("margin_change", F.lit(0.0))) >= margin, F.concat(F.lit("margin_change="), fmt(F.col("margin_change"))))]
    own = F.col("triggered_event") if "triggered_event" in t.columns else F.lit(None).cast("string")
    text = F.nullif(F.concat_ws(" | ", *parts), F.lit(""))
    return t.withColumn("triggered_event", F.coalesce(own, text))


def leaders(rets: DataFrame, n: int = 3) -> DataFrame:
    """Best and worst n industries of each date (positive ranks from the top, negative from the bottom)."""
    rows = rets.filter("r is not null").select(F.col("d").alias("date"), "industry_code", "r")
    w = Window.partitionBy("date")
    up = F.row_number().over(w.orderBy(F.desc("r"), "industry_code"))
    down = F.row_number().over(w.orderBy("r", "industry_code"))
    both = rows.withColumns({"up": up, "down": down})
    return both.filter(F.col("up") <= n).select("date", "industry_code", "r", F.col("up").alias("rank")).unionByName(
        both.filter(F.col("down") <= n).select("date", "industry_code", "r", (-F.col("down")).alias("rank")))


def tick_edges(t: DataFrame, top: int = 3) -> DataFrame:
    """Edges a tick implies: two fixed ones, one per strongest mover, one for a shock. No join."""
    def edge(source: Column, target: Column, relation: str, weight: float, evidence: Column) -> Column:
        return F.struct(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit(weight).alias("weight"), F.array(evidence).alias("evidence_ids"))

    movers = F.array_sort(F.transform(F.map_entries("industry_returns"), lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("k"))))
    fixed = F.array(edge(F.lit("market"), F.lit("all_industries"), "affects", 0.8, F.lit("market_tick")),
                    edge(F.lit("capital_flow"), F.lit("market"), "causes", 0.6, F.lit("margin_change")))
    moved = F.transform(F.slice(F.coalesce(movers, F.array().cast("array<struct<o:double,k:string>>")), 1, top),
                        lambda m: edge(F.lit("event"), m["k"], "affects", 0.7, F.lit("industry_move")))
    shock = F.filter(F.array(F.when(F.col("triggered_event").isNotNull(), edge(F.lit("triggered_event"), F.lit("market"), "causes", 0.75, F.col("triggered_event")))), lambda x: x.isNotNull())
    return t.select("date", F.explode(F.concat(fixed, moved, shock)).alias("e")).select("date", "e.*")


def trace(t: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy("date").agg(F.count("*").alias("n_causal_paths"), F.countDistinct("source").alias("n_sources"))
    return t.select("date", "market_return").join(n, "date", "left").fillna(0, ["n_causal_paths", "n_sources"])


def whatif_edges(t: DataFrame, perturb: DataFrame, top: int = 3) -> DataFrame:
    """Edges that appear only under a perturbed tick (date, market_return, triggered_event overrides)."""
    p = perturb.select("date", F.col("market_return").alias("_m"), F.col("triggered_event").alias("_t"))
    hit = t.join(p, "date")
    changed = hit.withColumns({"market_return": F.coalesce("_m", "market_return"), "triggered_event": F.coalesce("_t", "triggered_event")})
    return tick_edges(changed, top).exceptAll(tick_edges(hit, top))


def tick_windows(src: DataFrame, kind: str, size: str = "1 hour", slide: str | None = None, key: str = "industry_code") -> DataFrame:
    """Count, sum and mean of tick values per event-time window; the same expression serves batch and stream."""
    w = {"tumbling": lambda: F.window("ts", size), "sliding": lambda: F.window("ts", size, slide), "session": lambda: F.session_window("ts", size)}[kind]()
    g = src.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), key, "n", "total", "mean")


def residual_monitor(df: DataFrame, by: Sequence[str], order: Sequence[str], threshold: float, window: int = 5, coverage_window: int = 20, min_coverage: float = 0.70) -> DataFrame:
    """Trigger when the mean of the last absolute residuals is too large or the interval coverage too low.

    Needs columns residual and in_interval; `by` should include a bounded series key
    (one value per trading day).
    """
    w = Window.partitionBy(*by).orderBy(*order)
    near, far = w.rowsBetween(-(window - 1), 0), w.rowsBetween(-(coverage_window - 1), 0)
    n = F.row_number().over(w)
    avg = F.avg(F.abs("residual")).over(near)
    cov = F.avg(F.col("in_interval").cast("double")).over(far)
    big, low = (n >= window) & (avg > threshold), (n >= coverage_window) & (cov < min_coverage)
    return df.withColumns({"recent_residual": F.when(n >= window, avg), "recent_coverage": F.when(n >= coverage_window, cov),
                           "reason": F.when(big, "residual").when(low, "coverage")}).withColumn("triggered", F.col("reason").isNotNull())
