"""Leak-safe features: rolling state on panel rows, read by a strict as-of join."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.functions.cols import clip, div
from evq.functions.windows import asof_join, full_window, trailing
from evq.operators.asof import dense_returns

IND = ["industry_code"]


def _zero(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def returns(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy(*IND).orderBy("d")
    return panel.withColumns({"ret": div("close", F.lag("close").over(w)) - 1, "vol_chg": div("volume", F.lag("volume").over(w)) - 1})


def features(panel: DataFrame, mkt: DataFrame, how: str = "left") -> DataFrame:
    """Price panel joined to the index with returns, 5-row volatility and moving-average gaps.

    how='left' keeps industry dates without an index value, 'inner' drops them first.
    """
    df = returns(panel.select("industry_code", "d", "close", "volume").join(mkt.select("d", "mkt_close"), "d", how))
    w, w5, w20 = Window.partitionBy(*IND).orderBy("d"), trailing(IND, "d", 5), trailing(IND, "d", 20)
    df = df.withColumn("mkt_ret", div("mkt_close", F.lag("mkt_close").over(w)) - 1)

    def gap(wn, n):
        return div(full_window(F.avg("close").over(wn), F.count("close").over(wn), n), "close") - 1

    return df.withColumns({
        "volatility": full_window(F.stddev_samp("ret").over(w5), F.count("ret").over(w5), 5),
        "ma5_gap": gap(w5, 5), "ma20_gap": gap(w20, 20)})


def market_state(feat: DataFrame, lookback: int = 250) -> DataFrame:
    """Snapshot values at every panel row, over the last `lookback` complete rows."""
    rows = feat.filter("ret is not null and mkt_ret is not null")
    near, far = trailing(IND, "d", 20), trailing(IND, "d", lookback)
    n = F.count("*").over(far)
    recent, hist = F.stddev_pop("volatility").over(near) + 1e-8, F.stddev_pop("ret").over(far) + 1e-8
    mom = F.sum("ret").over(near)
    return rows.select(
        "industry_code", "d", mom.alias("momentum_20"), (mom - F.sum("mkt_ret").over(near)).alias("relative_strength_20"),
        recent.alias("recent_vol"), hist.alias("hist_vol"), (recent / hist - 1).alias("vol_regime"),
        F.when(n >= 20, F.avg("vol_chg").over(near)).otherwise(0.0).alias("volume_trend"),
        _zero("ma5_gap").alias("ma5_gap"), _zero("ma20_gap").alias("ma20_gap"), n.alias("n_hist"))


MARKET = ("momentum_20", "relative_strength_20", "recent_vol", "hist_vol", "vol_regime", "volume_trend", "ma5_gap", "ma20_gap", "n_hist")


def market_snapshot(events: DataFrame, feat: DataFrame, lookback: int = 250) -> DataFrame:
    return asof_join(events, market_state(feat, lookback), IND, "event_date", "d", MARKET)


def share_below(values: Column, current: Column) -> Column:
    """Share of an array strictly below a value; the array includes the value itself."""
    return F.when(F.size(values) > 0, F.size(F.filter(values, lambda x: x < current)) / F.size(values))


def running_percentiles(rows: DataFrame, by: Sequence[str], on: str, columns: dict[str, str]) -> DataFrame:
    """For each {value: name}, the share of the values so far that lie strictly below the latest one.

    A series is bounded by its calendar; its values are kept sorted as they come, so a row costs a
    binary search and no array per row is built.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(on)
        for value, name in columns.items():
            seen, last, out = [], None, []
            for v in pdf[value].tolist():
                if v is not None and v == v:
                    insort(seen, v)
                    last = v
                out.append(bisect_left(seen, last) / len(seen) if seen else None)
            pdf[name] = pd.Series(out, index=pdf.index, dtype="float64")
        return pdf

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{n}` double" for n in columns.values())])
    return rows.groupBy(*by).applyInPandas(run, kinds)


def valuation_state(val: DataFrame, min_rows: int = 60) -> DataFrame:
    """Percentile of the current PE and PB within the industry's history, per panel row."""
    rows = val.filter("pe_ttm is not null")
    w = Window.partitionBy(*IND).orderBy("d")
    run = trailing(IND, "d", None)
    ranked = running_percentiles(rows.select("industry_code", "d", "pe_ttm", "pb", "dividend_yield"), IND, "d", {"pe_ttm": "_pe", "pb": "_pb"})
    base = ranked.select(
        "industry_code", "d", "pe_ttm", "_pe", "_pb", F.count("*").over(run).alias("n_hist"), F.last("pb", True).over(run).alias("pb_now"),
        F.last("dividend_yield", True).over(run).alias("dividend_yield"), F.lag("pe_ttm", 20).over(w).alias("_pe20"))
    ok = F.col("n_hist") >= min_rows
    pct = base.withColumns({"pe_percentile": F.when(ok, F.col("_pe")), "pb_percentile": F.when(ok, F.col("_pb"))})
    return pct.select(
        "industry_code", "d", "n_hist", F.when(ok, F.col("pe_ttm")).alias("pe_now"), "pe_percentile",
        F.when(ok, F.col("pb_now")).alias("pb_now"), "pb_percentile", F.when(ok, F.col("dividend_yield")).alias("dividend_yield"),
        (-(F.col("pe_percentile") - 0.5) * 2).alias("valuation_signal"),
        (F.abs(F.col("pe_percentile") - 0.5) * 2).alias("valuation_confidence"),
        F.when(ok, div("pe_ttm", "_pe20") - 1).alias("pe_momentum_20"))


VALUATION = ("pe_now", "pe_percentile", "valuation_signal", "valuation_confidence", "pb_now", "pb_percentile", "dividend_yield")


def valuation_snapshot(events: DataFrame, val: DataFrame, min_rows: int = 60) -> DataFrame:
    state = valuation_state(val, min_rows).select("industry_code", "d", *VALUATION)
    return asof_join(events, state, IND, "event_date", "d", VALUATION)


def valuation_probe(events: DataFrame, val: DataFrame, min_rows: int = 60) -> DataFrame:
    """Snapshot with 20-row PE momentum; too little history gives a neutral probe."""
    cols = ["n_hist", "pe_percentile", "pb_percentile", "dividend_yield", "pe_momentum_20", "valuation_signal", "valuation_confidence"]
    out = asof_join(events, valuation_state(val, min_rows), IND, "event_date", "d", cols)
    neutral = {"n_hist": F.lit(0).cast("long"), "pe_percentile": F.lit(0.5), "pb_percentile": F.lit(0.5)}
    out = out.withColumns({c: F.coalesce(F.col(c), neutral.get(c, F.lit(0.0))) for c in cols})
    return out.withColumn("valuation_confidence", F.round(F.round("valuation_confidence", 6), 4))


def froth_state(margin: DataFrame, mom_window: int = 20, hist_window: int = 250) -> DataFrame:
    w = Window.orderBy("d")
    mom = div("total_fin", F.lag("total_fin", mom_window).over(w)) - 1
    rows = margin.select("d", mom.alias("mom"), F.row_number().over(w).alias("n_hist"))
    hist = F.collect_list("mom").over(trailing([], "d", hist_window))
    rows = rows.withColumn("_h", hist)
    ok = (F.col("n_hist") >= mom_window + 30) & (F.size("_h") >= 20) & F.col("mom").isNotNull()
    pct = share_below(F.col("_h"), F.col("mom"))
    return rows.select("d", F.when(ok, F.col("mom")).alias("margin_momentum_20"), F.when(ok, 2 * pct - 1).alias("froth"),
                       F.when(ok, pct).alias("froth_percentile"), F.col("n_hist").alias("margin_n"))


def froth(events: DataFrame, margin: DataFrame, mom_window: int = 20, hist_window: int = 250) -> DataFrame:
    """Leverage momentum and its percentile in [-1, 1]; null before enough history."""
    return asof_join(events, froth_state(margin, mom_window, hist_window), [], "event_date", "d",
                     ["margin_momentum_20", "froth", "froth_percentile", "margin_n"])


def macro_snapshot(events: DataFrame, rates: DataFrame, cols: Sequence[str] = ("rate_1", "rate_2")) -> DataFrame:
    """Rate on the last row and its change from the previous non-null rate."""
    run = trailing([], "d", None)
    prev = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    state = rates.select("d", F.count("*").over(run).alias("macro_n"), *cols,
                         *[(F.col(c) - F.last(c, True).over(prev)).alias(f"{c}_chg") for c in cols])
    return asof_join(events, state, [], "event_date", "d", ["macro_n", *cols, *[f"{c}_chg" for c in cols]])


def build_features(events: DataFrame, feat: DataFrame, val: DataFrame, margin: DataFrame, rates: DataFrame) -> DataFrame:
    """One leak-safe feature row per scenario.

    Snapshots are gathered on distinct (industry, date) keys; the wide scenario table is
    joined once. The later snapshot's n_hist wins, as in a dictionary update.
    """
    keys = events.select("industry_code", "event_date").distinct()
    state = valuation_state(val).select("industry_code", "d", *VALUATION, F.when(F.col("pe_now").isNotNull(), F.col("n_hist")).alias("val_n"))
    wide = asof_join(market_snapshot(keys, feat), state, IND, "event_date", "d", [*VALUATION, "val_n"])
    wide = macro_snapshot(froth(wide, margin), rates)
    n = F.coalesce("macro_n", F.when(F.col("froth").isNotNull(), F.col("margin_n")), "val_n", "n_hist")
    return events.join(wide.withColumn("n_hist", n).drop("macro_n", "margin_n", "val_n"), ["industry_code", "event_date"], "left")


BASELINE = ("ind_r5", "ind_r20", "mkt_r5", "mkt_r20", "rel_r5", "rel_r20", "vol20", "pos60", "vtrend")


def baseline_features(events: DataFrame, panel: DataFrame, mkt: DataFrame, min_rows: int = 25) -> DataFrame:
    """Nine price features of the last rows before each event; null below min_rows rows."""
    w = Window.partitionBy(*IND).orderBy("d")
    rows = panel.filter("close is not null").withColumn("lr", F.log("close") - F.log(F.lag("close").over(w)))
    n = F.row_number().over(w)
    w60, w20, w5 = trailing(IND, "d", 60), trailing(IND, "d", 20), trailing(IND, "d", 5)
    lo, hi = F.min("close").over(w60), F.max("close").over(w60)
    v5, v20 = F.avg("volume").over(w5), F.avg("volume").over(w20)
    ind = rows.select(
        "industry_code", "d", n.alias("n_ind"), _zero(div("close", F.lag("close", 5).over(w)) - 1).alias("ind_r5"),
        _zero(div("close", F.lag("close", 20).over(w)) - 1).alias("ind_r20"),
        F.when(n >= 21, F.stddev_pop("lr").over(w20)).otherwise(0.0).alias("vol20"),
        F.when(hi > lo, (F.col("close") - lo) / F.when(hi > lo, hi - lo)).otherwise(0.5).alias("pos60"),
        F.when((F.count("volume").over(w20) >= 20) & (v20 > 0), div(v5, v20) - 1).otherwise(0.0).alias("vtrend"))
    g = Window.orderBy("d")
    m = mkt.filter("mkt_close is not null").select(
        "d", F.row_number().over(g).alias("n_mkt"), _zero(div("mkt_close", F.lag("mkt_close", 5).over(g)) - 1).alias("mkt_r5"),
        _zero(div("mkt_close", F.lag("mkt_close", 20).over(g)) - 1).alias("mkt_r20"))
    keys = events.select("industry_code", "event_date").distinct()
    got = asof_join(asof_join(keys, ind, IND, "event_date", "d", [c for c in ind.columns if c not in ("industry_code", "d")]),
                    m, [], "event_date", "d", ["n_mkt", "mkt_r5", "mkt_r20"])
    got = got.withColumns({"rel_r5": F.col("ind_r5") - F.col("mkt_r5"), "rel_r20": F.col("ind_r20") - F.col("mkt_r20")})
    ok = (F.col("n_ind") >= min_rows) & (F.col("n_mkt") >= min_rows)
    got = got.select("industry_code", "event_date", *[F.when(ok, F.col(c)).alias(c) for c in BASELINE])
    return events.join(got, ["industry_code", "event_date"], "left")


def state_probe(events: DataFrame, feat: DataFrame, lookback: int = 20, scale: float = 0.05) -> DataFrame:
    """Pre-event drift squashed to [-1, 1] with a calm-scaled confidence; neutral when cold."""
    rows = feat.dropna(subset=["ret", "vol_chg", "volatility", "mkt_ret", "ma5_gap", "ma20_gap"])
    near, run = trailing(IND, "d", lookback), trailing(IND, "d", None)
    mom = F.sum("ret").over(near)
    base = rows.select(
        "industry_code", "d", F.count("*").over(run).alias("n_hist"), mom.alias("momentum"), (mom - F.sum("mkt_ret").over(near)).alias("rel"),
        ((F.stddev_pop("ret").over(near) + 1e-8) / (F.stddev_pop("ret").over(run) + 1e-8) - 1).alias("vol_regime"),
        F.col("ma20_gap").alias("valuation_pos"), F.avg("vol_chg").over(near).alias("volume_trend"))
    state = base.withColumn("pre_state", F.tanh((0.6 * F.col("momentum") + 0.4 * F.col("rel")) / scale))
    state = state.withColumn("confidence", F.round(F.abs("pre_state") / (1 + F.greatest("vol_regime", F.lit(0.0))), 4))
    vals = ["momentum", "rel", "vol_regime", "valuation_pos", "volume_trend", "pre_state", "confidence"]
    warm = F.col("n_hist") >= lookback
    state = state.select("industry_code", "d", "n_hist", *[F.when(warm, F.col(c)).otherwise(0.0).alias(c) for c in vals])
    out = asof_join(events, state, IND, "event_date", "d", ["n_hist", *vals])
    return out.withColumns({"n_hist": F.coalesce("n_hist", F.lit(0).cast("long")), **{c: _zero(c) for c in vals}})


def blend_confidence(cells: DataFrame, probes: DataFrame, keys: Sequence[str], cell: str = "cell_confidence",
                     probe: str = "confidence") -> DataFrame:
    """Average a probe's confidence into a cell, at most one; an empty cell takes the probe's."""
    out = cells.join(probes.select(*keys, F.col(probe).alias("_p")), list(keys), "left")
    mixed = F.when(_zero(cell) == 0, F.col("_p")).otherwise(F.least(F.lit(1.0), 0.5 * F.col(cell) + 0.5 * F.col("_p")))
    return out.withColumn(cell, F.when(F.col("_p").isNull(), F.col(cell)).otherwise(mixed)).drop("_p")


def drift_dampen(df: DataFrame, pre_cum: str = "pre_cum", strength: str = "strength", typical: float = 0.03,
                 start: float = 0.3, rate: float = 0.6, most: float = 0.6) -> DataFrame:
    """Shrink a signal the market already moved with; the drift ratio is |pre_cum| / typical."""
    ratio = F.abs(pre_cum) / typical
    same = (F.col(pre_cum) > 0) == (F.col(strength) > 0)
    factor = F.when(same & (ratio > start), 1 - F.least(ratio * rate, F.lit(most))).otherwise(1.0)
    return df.withColumns({"drift_ratio": ratio, "dampen": factor, "dampened": F.col(strength) * factor})


def pre_drift(events: DataFrame, feat: DataFrame, n: int = 10) -> DataFrame:
    rows = feat.filter("ret is not null")
    state = rows.select("industry_code", "d", F.sum("ret").over(trailing(IND, "d", n)).alias("pre_cum"))
    return asof_join(events, state, IND, "event_date", "d", ["pre_cum"])


def vol_ratio(events: DataFrame, feat: DataFrame, n: int = 10, strength: Column | None = None) -> DataFrame:
    """Recent over historical population sd, clipped to [.5, 4], and the interval strength it implies."""
    rows = feat.filter("ret is not null")
    ratio = (F.stddev_pop("ret").over(trailing(IND, "d", n)) + 1e-8) / (F.stddev_pop("ret").over(trailing(IND, "d", None)) + 1e-8)
    out = asof_join(events, rows.select("industry_code", "d", clip(ratio, 0.5, 4).alias("vol_ratio")), IND, "event_date", "d", ["vol_ratio"])
    s = F.lit(0.0) if strength is None else F.abs(strength)
    return out.withColumn("interval_strength", F.greatest(s, (F.col("vol_ratio") - 1) * 0.5, F.lit(0.15)))


def pivot_returns(panel: DataFrame, mkt: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Date by industry return matrix for a named list of industries."""
    rets = dense_returns(panel, mkt)
    return rets.groupBy("d").pivot("industry_code", list(codes)).agg(F.max("r"))


def text_strength(events: DataFrame, terms: Sequence[str], negative: Sequence[str], text: str = "text") -> DataFrame:
    """Signed fallback strength: .15, .30 or .50 by hits of high-impact terms."""
    low = F.lower(F.col(text))
    hits = sum((low.contains(t).cast("int") for t in terms), F.lit(0))
    neg = F.lit(False)
    for t in negative:
        neg = neg | low.contains(t)
    size = F.when(hits >= 2, 0.5).when(hits == 1, 0.3).otherwise(0.15)
    return events.withColumns({"hits": hits, "text_strength": F.when(neg, -size).otherwise(size)})
