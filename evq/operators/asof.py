"""Temporal firewall: anchors, strict pre-event history, document visibility, windows.

Every event-keyed result depends on (entity, date) only, so it is computed once per
distinct pair along the panel and joined to the events by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.functions.cols import div
from evq.functions.windows import asof_join, past_totals, trailing

FEATURE_COLS = ("ret", "vol_chg", "volatility", "mkt_ret", "ma5_gap", "ma20_gap")


def calendar(panel: DataFrame, mkt: DataFrame) -> DataFrame:
    """Trading days present in both series with a dense index from zero."""
    days = panel.select("d").intersect(mkt.select("d"))
    return days.select("d", (F.row_number().over(Window.orderBy("d")) - 1).alias("day_idx"))


def anchor(events: DataFrame, cal: DataFrame) -> DataFrame:
    """First trading day on or after the event date; events after the last day get null."""
    return asof_join(events, cal, [], "event_date", "d", ["day_idx"], direction="forward", strict=False, fact_date="t0"
                     ).withColumnRenamed("day_idx", "t0_idx")


def dense_returns(panel: DataFrame, mkt: DataFrame) -> DataFrame:
    """Industry and market return on every trading day of the common calendar.

    A return next to a missing price is null, as in a date by industry matrix.
    """
    cal = calendar(panel, mkt).join(mkt, "d")
    last = cal.agg(F.max("day_idx")).scalar()
    codes = panel.select("industry_code").distinct()
    slots = codes.select("industry_code", F.explode(F.sequence(F.lit(0), last)).alias("day_idx"))
    wide = slots.join(cal, "day_idx").join(panel.select("industry_code", "d", "close"), ["industry_code", "d"], "left")
    w = Window.partitionBy("industry_code").orderBy("day_idx")
    return wide.select(
        "industry_code", "d", "day_idx", (div("close", F.lag("close").over(w)) - 1).alias("r"),
        (div("mkt_close", F.lag("mkt_close").over(w)) - 1).alias("m"))


def pre_event(events: DataFrame, panel: DataFrame, value: str = "close") -> DataFrame:
    """Summary of all panel rows strictly before each event: count, span and total."""
    w = trailing(["industry_code"], "d", None)
    state = panel.select("industry_code", "d", F.count("*").over(w).alias("n_rows"), F.min("d").over(w).alias("first_d"),
                         F.sum(value).over(w).alias("total"))
    out = asof_join(events, state, ["industry_code"], "event_date", "d", ["n_rows", "first_d", "total"], fact_date="last_d")
    return out.withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))


def visible_from(pub: str = "pub_date", valid: str = "valid_from", mode: str = "strict") -> Column:
    """First day a document may be seen; null for undated ones, which stay hidden.

    valid_from wins and is inclusive; a publication day counts from the next day in
    strict mode and from the same day in inclusive mode.
    """
    shown = F.date_add(F.col(pub), 1) if mode == "strict" else F.col(pub)
    return F.coalesce(F.col(valid), shown)


def visible(t: Column, mode: str = "strict") -> Column:
    return F.coalesce(visible_from(mode=mode) <= t, F.lit(False))


def leaks(package: DataFrame, chunks: DataFrame, mode: str = "strict") -> DataFrame:
    """Package rows (query_id, doc_id, as_of) whose document was not visible at as_of."""
    dim = chunks.select("doc_id", visible_from(mode=mode).alias("_from"))
    return package.join(dim, "doc_id", "left").filter(~F.coalesce(F.col("_from") <= F.col("as_of"), F.lit(False))).drop("_from")


def visibility_run(chunks: DataFrame, mode: str = "strict") -> tuple[DataFrame, int]:
    """Running count of visible documents by date, and the number of documents."""
    starts = chunks.select(visible_from(mode=mode).alias("from_d")).filter("from_d is not null")
    return past_totals(starts, [], "from_d", {"n_visible": F.lit(1)}, inclusive=True), chunks.count()


def visible_at(events: DataFrame, run: DataFrame, total: int) -> DataFrame:
    out = asof_join(events, run, [], "event_date", "from_d", ["n_visible"], strict=False)
    seen = F.coalesce(F.col("n_visible"), F.lit(0).cast("long"))
    return out.withColumn("n_visible", seen).withColumn("n_hidden", F.lit(total) - F.col("n_visible"))


def visibility_counts(events: DataFrame, chunks: DataFrame, mode: str = "strict") -> DataFrame:
    """Visible and hidden documents per event from one running count over dates."""
    return visible_at(events, *visibility_run(chunks, mode))


def n_past_events(events: DataFrame) -> DataFrame:
    """Events dated strictly before each event."""
    return events.join(past_totals(events, [], "event_date", {"n_past": F.lit(1)}), "event_date")


def event_window(feat: DataFrame, events: DataFrame, seq: int, pred: int) -> tuple[DataFrame, DataFrame]:
    """Status per scenario, and the [t0-seq, t0+pred) rows once per (industry, anchor).

    Feature rows are numbered per industry after null rows are dropped. A scenario that
    lacks rows carries the reason instead of raising.
    """
    clean = feat.dropna(subset=list(FEATURE_COLS))
    w = Window.partitionBy("industry_code").orderBy("d")
    numbered = clean.select("industry_code", "d", *FEATURE_COLS, (F.row_number().over(w) - 1).alias("idx"),
                            F.count("*").over(Window.partitionBy("industry_code")).alias("n"))
    got = asof_join(events, numbered, ["industry_code"], "event_date", "d", ["idx", "n"], direction="forward",
                    strict=False, fact_date="t0")
    status = (F.when(F.col("idx").isNull(), "no_rows_after").when(F.col("idx") < seq, "short_before")
              .when(F.col("idx") + pred > F.col("n"), "short_after").otherwise("ok"))
    status_df = got.select(*events.columns, "t0", F.col("idx").alias("t0_row"), status.alias("status"))
    anchors = status_df.filter("status = 'ok'").select("industry_code", "t0", "t0_row").distinct()
    slots = anchors.select("industry_code", "t0", F.col("t0_row"), F.explode(F.sequence(F.lit(-seq), F.lit(pred - 1))).alias("off"))
    rows = slots.withColumn("idx", F.col("t0_row") + F.col("off")).join(numbered.drop("n"), ["industry_code", "idx"])
    return status_df, rows.select("industry_code", "t0", "off", "d", *FEATURE_COLS)


def window_zscore(rows: DataFrame, cols=FEATURE_COLS) -> DataFrame:
    """Scale each event window by mean and population sd of its input part only."""
    w = Window.partitionBy("industry_code", "t0")
    past = [F.when(F.col("off") < 0, F.col(c)) for c in cols]
    return rows.select("industry_code", "t0", "off", *[
        ((F.col(c) - F.avg(p).over(w)) / (F.stddev_pop(p).over(w) + 1e-8)).alias(c) for c, p in zip(cols, past)])


def history_zscore_stats(feat: DataFrame, events: DataFrame, share: float = 0.8, cols=FEATURE_COLS) -> DataFrame:
    """Mean and population sd over the first int(share*n) pre-event rows of each scenario.

    Running moments are kept at every row, so the cutoff is one equality join.
    """
    clean = feat.dropna(subset=list(cols))
    w = Window.partitionBy("industry_code").orderBy("d")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = clean.select("industry_code", "d", F.row_number().over(w).alias("n_hist"),
                            *[F.avg(c).over(run).alias(f"{c}_mean") for c in cols],
                            *[(F.stddev_pop(c).over(run) + 1e-8).alias(f"{c}_std") for c in cols])
    got = asof_join(events, numbered, ["industry_code"], "event_date", "d", ["n_hist"])
    moments = numbered.drop("d").withColumnRenamed("n_hist", "n_fit")
    return got.withColumn("n_fit", F.floor(F.col("n_hist") * share).cast("int")).join(moments, ["industry_code", "n_fit"], "left")


def pre_event_matrix(feat: DataFrame, events: DataFrame, n: int, cols=FEATURE_COLS) -> DataFrame:
    """Last n complete feature rows before each distinct (industry, event date), long form."""
    clean = feat.dropna(subset=list(cols))
    state = clean.select("industry_code", "d", F.collect_list(F.struct("d", *cols)).over(
        Window.partitionBy("industry_code").orderBy("d").rowsBetween(-(n - 1), 0)).alias("rows"))
    keys = events.select("industry_code", "event_date").distinct()
    got = asof_join(keys, state, ["industry_code"], "event_date", "d", ["rows"], how="inner")
    return got.select("industry_code", "event_date", F.posexplode("rows").alias("pos", "row")).select(
        "industry_code", "event_date", "pos", "row.*")


def make_windows(feat: DataFrame, in_len: int, out_len: int, step: int = 1, value: str = "ret") -> DataFrame:
    """Overlapping training windows as arrays: x of in_len values, y of the next out_len."""
    w = Window.partitionBy("industry_code").orderBy("d")
    rows = feat.filter(F.col(value).isNotNull())
    full = rows.select(
        "industry_code", "d", (F.row_number().over(w) - 1).alias("start"),
        F.collect_list(value).over(w.rowsBetween(0, in_len + out_len - 1)).alias("v"))
    return full.filter((F.size("v") == in_len + out_len) & (F.col("start") % step == 0)).select(
        "industry_code", F.col("d").alias("start_d"), "start", F.slice("v", 1, in_len).alias("x"),
        F.slice("v", in_len + 1, out_len).alias("y"))
