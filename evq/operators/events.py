"""Event study: scenarios, abnormal returns, realised paths, event curation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.functions.lineage import cut
from evq.functions.ordered import ordered_rank
from evq.functions.cols import clip, log1p_or_zero, r6
from evq.functions.sizing import settled
from evq.operators.asof import anchor, calendar, dense_returns


def scenarios(events: DataFrame, industries: DataFrame, list_col: str = "affected_industries") -> DataFrame:
    """One row per event and listed industry; codes absent from the panel are dropped.

    The list is split on commas (ASCII or full width), semicolons or blanks.
    """
    codes = F.array_distinct(F.filter(F.split(F.col(list_col), "[,，;；\\s]+"), lambda x: F.trim(x) != ""))
    rows = events.select(*[c for c in events.columns if c != list_col], F.explode(codes).alias("industry_code"))
    return rows.join(industries.select("industry_code").distinct(), "industry_code", "left_semi")


def _anchored(scn: DataFrame, panel: DataFrame, mkt: DataFrame) -> tuple[DataFrame, DataFrame]:
    at = anchor(scn.select("event_date").distinct(), calendar(panel, mkt)).filter("t0 is not null")
    return scn.join(settled(at), "event_date"), dense_returns(panel, mkt)


def car_diff(scn: DataFrame, panel: DataFrame, mkt: DataFrame, windows: Sequence[int] = (1, 5, 20)) -> DataFrame:
    """Compounded industry minus compounded market return over t0..t0+k, k+1 returns.

    Windows are computed once per industry and day; windows past the end are skipped.
    """
    anchored, rets = _anchored(scn, panel, mkt)
    w = Window.partitionBy("industry_code").orderBy("day_idx")
    parts = []
    for k in windows:
        f = w.rowsBetween(0, k)
        parts.append(F.when(F.count("*").over(f) == k + 1, F.struct(
            F.lit(k).alias("window"), (F.exp(F.sum(log1p_or_zero("r")).over(f)) - 1).alias("i"),
            (F.exp(F.sum(log1p_or_zero("m")).over(f)) - 1).alias("m"))))
    per_day = rets.select("industry_code", F.col("day_idx").alias("t0_idx"), F.array(*parts).alias("a"))
    per_day = per_day.select("industry_code", "t0_idx", F.explode("a").alias("c")).filter("c is not null")
    per_day = per_day.select("industry_code", "t0_idx", "c.window", r6("c.i").alias("cum_ind_ret"),
                             r6("c.m").alias("cum_mkt_ret"), r6(F.col("c.i") - F.col("c.m")).alias("car"))
    return anchored.join(settled(per_day), ["industry_code", "t0_idx"]).drop("t0_idx")


def forward_path_metrics(rets: DataFrame, horizons: Sequence[int], inclusive_end: bool) -> DataFrame:
    """Active path per industry and start day: CAR by ratio, drawdown, cumulatives."""
    w = Window.partitionBy("industry_code").orderBy("day_idx")
    start = F.struct(*[F.lit(v).alias(n) for v, n in ((1.0, "nav"), (1.0, "peak"), (0.0, "mdd"), (1.0, "ind"), (1.0, "mkt"))])

    def step(a: Column, x: Column) -> Column:
        gross = F.coalesce(F.try_divide(1.0 + x["r"], 1.0 + x["m"]), F.lit(1.0))
        nav = a["nav"] * gross
        peak = F.greatest(a["peak"], nav)
        return F.struct(nav.alias("nav"), peak.alias("peak"),
                        F.greatest(a["mdd"], (peak - nav) / F.greatest(peak, F.lit(1e-12))).alias("mdd"),
                        (a["ind"] * (1.0 + x["r"])).alias("ind"), (a["mkt"] * (1.0 + x["m"])).alias("mkt"))

    sizes = {h: h + 1 if inclusive_end else h for h in horizons}
    ahead = F.collect_list("rm").over(w.rowsBetween(0, max(sizes.values()) - 1))
    parts = [F.when(F.size("path") >= n, F.struct(
        F.lit(h).alias("horizon"), F.lit(n).alias("n_returns"), F.aggregate(F.slice("path", 1, n), start, step).alias("s")))
        for h, n in sizes.items()]
    zeroed = rets.select("industry_code", "day_idx", F.struct(
        F.coalesce("r", F.lit(0.0)).alias("r"), F.coalesce("m", F.lit(0.0)).alias("m")).alias("rm"))
    rows = zeroed.select("industry_code", F.col("day_idx").alias("t0_idx"), ahead.alias("path"))
    rows = rows.select("industry_code", "t0_idx", F.explode(F.array(*parts)).alias("c")).filter("c is not null")
    car = F.col("c.s.nav") - 1.0
    return rows.select("industry_code", "t0_idx", "c.horizon", "c.n_returns", car.alias("realized_car"),
                       clip("c.s.mdd", 0, 1).alias("realized_mdd"), F.greatest(-car, F.lit(0.0)).alias("realized_downside"),
                       (F.col("c.s.ind") - 1).alias("industry_cum"), (F.col("c.s.mkt") - 1).alias("market_cum"))


def realized_path(scn: DataFrame, panel: DataFrame, mkt: DataFrame, horizons: Sequence[int] = (1, 5, 20),
                  inclusive_end: bool = True) -> DataFrame:
    """Active-return path metrics per scenario and horizon (h+1 returns if inclusive_end, else h)."""
    anchored, rets = _anchored(scn, panel, mkt)
    return anchored.join(settled(forward_path_metrics(rets, horizons, inclusive_end)), ["industry_code", "t0_idx"]).drop("t0_idx")


def car_summary(car: DataFrame, direction: str | None = None) -> DataFrame:
    rows = car if direction is None else car.filter(F.col("direction") == direction)
    return rows.groupBy("window").agg(F.avg("car").alias("mean_car"), F.stddev_samp("car").alias("std_car"), F.count("*").alias("n"))


def car_top(car: DataFrame, window: int = 5, n: int = 10) -> DataFrame:
    keys = [F.desc("car"), "event_date", "event_id", "industry_code"]
    return car.filter(F.col("window") == window).orderBy(*keys).limit(n).select("event_date", "event_id", "industry_code", "car")


def cell_stats(car: DataFrame, window: int = 5, names: DataFrame | None = None) -> DataFrame:
    out = car.filter(F.col("window") == window).groupBy("event_type", "industry_code").agg(
        F.count("*").alias("n"), F.avg((F.col("car") >= 0).cast("double")).alias("p_pos"), F.avg("car").alias("mean_car"))
    return out if names is None else out.join(names, "industry_code", "left")


def car_decomposition(car: DataFrame, window: int = 5) -> DataFrame:
    """Absolute, market and relative return by event type with shares of positive ones."""
    parts = {"abs": "cum_ind_ret", "mkt": "cum_mkt_ret", "rel": "car"}
    return car.filter(F.col("window") == window).groupBy("event_type").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{k}") for k, c in parts.items()],
        *[F.avg((F.col(c) > 0).cast("double")).alias(f"pos_{k}") for k, c in parts.items()])


def map_industries(events: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], text: str = "text") -> DataFrame:
    """Codes of every matching rule, in rule order without repeats."""
    hits = [F.when(F.col(text).rlike(p), F.array(*[F.lit(c) for c in codes])).otherwise(F.array().cast("array<string>"))
            for p, codes in rules]
    return events.withColumn("industries", F.array_distinct(F.concat(*hits))).withColumn("n_map", F.size("industries"))


def banned_words(events: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Outcome words found in an event text, in order of appearance."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return events.withColumn("banned", F.array_join(found, "|")).withColumn("n_banned", F.size(found))


def merge_events(orig: DataFrame, cand: DataFrame) -> DataFrame:
    """Originals plus mapped candidates on dates the originals do not use; labels blanked."""
    new = cand.filter(F.coalesce(F.length("affected_industries"), F.lit(0)) > 0).join(
        orig.select("event_date").distinct(), "event_date", "left_anti")
    blank = new.withColumns({"direction": F.lit(""), "magnitude": F.lit("")})
    return orig.withColumn("origin", F.lit("orig")).unionByName(blank.withColumn("origin", F.lit("added")), allowMissingColumns=True)


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def split_corpus(docs: DataFrame, date_col: str = "pub_date") -> DataFrame:
    """Mark each document event-tied or quarantined (mechanism note or undated)."""
    away = (F.col("doc_type") == "mechanism") | F.col(date_col).isNull()
    return docs.withColumn("part", F.when(away, "quarantine").otherwise("event"))


def corpus_spans(split: DataFrame, date_col: str = "pub_date") -> DataFrame:
    return split.groupBy("part").agg(F.count("*").alias("n"), F.min(date_col).alias("first_pub"), F.max(date_col).alias("last_pub"))


def attach_event_type(results: DataFrame, car: DataFrame) -> DataFrame:
    """Type from the five-step label table; one label per key (the smallest if they differ)."""
    labels = car.filter(F.col("window") == 5).groupBy("event_date", "industry_code").agg(F.min("event_type").alias("event_type"))
    return results.drop("event_type").join(labels, ["event_date", "industry_code"], "left")


def match_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Assign every set of a (a_id, item) its own set of b (b_id, item): the best by Jaccard that no smaller a_id takes.

    The result is that of a pass over a in ascending order in which each set takes its best free b set
    (ties and no shared item: the smaller b_id); sets left over when b is used up get null. It is found in
    rounds: each set without a partner asks the best b set that is free or held by a larger a_id, and
    each b set keeps the smallest asker. Sets whose overlapping b sets are all refused ask in order of rank:
    the i-th of them asks the i-th b set open to the first. Only pairs with a shared item are laid out, for
    one representative of the sets of equal content.
    """
    a, b = a.select("a_id", "item").distinct(), b.select("b_id", "item").distinct()
    h1, h2 = F.xxhash64("item"), F.xxhash64(F.lit(17), "item")
    content = a.groupBy("a_id").agg(F.count("*").alias("na"), F.bit_xor(h1).alias("f1"), F.bit_xor(h2).alias("f2"))
    finger = ["na", "f1", "f2"]
    rep = content.groupBy(*finger).agg(F.min("a_id").alias("rep"))
    sets = cut(content.join(rep, finger).select("a_id", "rep", "na"))
    sizes = cut(b.groupBy("b_id").agg(F.count("*").alias("nb")))
    items = a.withColumnRenamed("a_id", "rep").join(sets.select("rep").distinct(), "rep", "left_semi")
    both = items.join(b, "item").groupBy("rep", "b_id").agg(F.count("*").alias("n_both")).join(sets.filter("a_id = rep").select("rep", "na"), "rep").join(sizes, "b_id")
    edges = cut(both.select("rep", "b_id", (F.col("n_both") / (F.col("na") + F.col("nb") - F.col("n_both"))).alias("jaccard")))
    held = cut(sizes.select("b_id").join(sets.select(F.col("a_id").alias("holder")).limit(0)))
    while True:
        alone = sets.join(held.select(F.col("holder").alias("a_id")), "a_id", "left_anti")
        open_to = lambda x: F.col("holder").isNull() | (F.col("holder") > x)
        asked = cut(alone.join(edges, "rep").join(held, "b_id", "left").filter(open_to(F.col("a_id"))).groupBy("a_id").agg(
            F.min(F.struct((-F.col("jaccard")).alias("j"), "b_id")).alias("x")).select("x.b_id", F.col("a_id").alias("holder")))
        refused = cut(alone.select("a_id").join(asked.select(F.col("holder").alias("a_id")), "a_id", "left_anti"))
        first = refused.agg(F.min("a_id")).first()[0]
        if first is not None:
            free = ordered_rank(sizes.select("b_id").join(held, "b_id", "left").filter(open_to(F.lit(first))).select("b_id"), [], ["b_id"])
            asked = asked.union(ordered_rank(refused, [], ["a_id"]).join(free, "rn").select("b_id", F.col("a_id").alias("holder")))
        asked = cut(asked)
        if asked.isEmpty():
            break
        held = cut(held.union(asked).groupBy("b_id").agg(F.min("holder").alias("holder")))
    out = sets.join(held.withColumnRenamed("holder", "a_id"), "a_id", "left").join(edges, ["rep", "b_id"], "left")
    jaccard = F.when(F.col("b_id").isNotNull(), F.coalesce("jaccard", F.lit(0.0)))
    return out.select("a_id", "b_id", jaccard.alias("jaccard"), F.coalesce(jaccard == 1, F.lit(False)).alias("exact"))
