"""Signals from stored responses and text, fusion scores and forecast corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.functions import terms as T
from evq.functions.cols import clip
from evq.functions.windows import asof_join, trailing

CHAIN = ("struct<chain:array<struct<step:int,layer:string,entity:string,industry_code:string,reasoning:string,evidence_ids:array<string>,"
         "confidence:double,impact_direction:string,impact_magnitude:string>>,overall_confidence:double,evidence_gaps:array<string>>")
VERDICT = "struct<direction:string,confidence:string,contested:string,magnitude:string,reason:string>"
RELDECOMP = "struct<beats_market:string,r_ind:string,r_mkt:string,confidence:string,magnitude:string>"


def hits(text: Column, words: Sequence[str]) -> Column:
    """Number of words of a list that occur in a text."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def _lookup(value: Column, table: dict[str, float], default: float) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[value], F.lit(default))


def json_part(content: Column) -> Column:
    """Widest brace-delimited part of a free answer (code fences and prose around it are cut)."""
    return F.regexp_extract(content, r"(?s)\{.*\}", 0)


def parse_chain(resp: DataFrame, key: str = "response_id", content: str = "content") -> DataFrame:
    """Stored reasoning chains as step rows in order."""
    parsed = F.from_json(json_part(F.col(content)), CHAIN)
    return resp.select(key, F.posexplode(parsed["chain"]).alias("pos", "st")).select(key, "pos", "st.*")


def factors_from_chain(steps: DataFrame, key: str = "response_id", magnitudes: dict[str, float] = T.STEP_MAGNITUDE) -> DataFrame:
    """Signed factor per entity; the last step of an entity wins and any sign but + counts as minus."""
    sign = F.when(F.col("impact_direction") == "+", 1.0).otherwise(-1.0)
    val = sign * _lookup(F.coalesce("impact_magnitude", F.lit("未知")), magnitudes, 0.0) * F.coalesce("confidence", F.lit(0.5))
    return steps.groupBy(key, F.coalesce("entity", F.lit("")).alias("entity")).agg(F.max_by(val, F.col("pos")).alias("factor"))


def transmission_cells(steps: DataFrame, key: str = "response_id", magnitudes: dict[str, float] = T.STEP_MAGNITUDE) -> DataFrame:
    """Per industry: largest magnitude and confidence, first non-zero direction."""
    d = F.when(F.col("impact_direction") == "+", 1).when(F.col("impact_direction") == "-", -1).otherwise(0)
    code = F.coalesce(F.nullif("industry_code", F.lit("")), "entity")
    rows = steps.select(key, code.alias("industry_code"), "pos", d.alias("d"), _lookup(F.coalesce("impact_magnitude", F.lit("未知")), magnitudes, 0.0).alias("m"),
                        F.coalesce("confidence", F.lit(0.5)).alias("c"))
    first = F.min_by(F.when(F.col("d") != 0, F.col("d")), F.when(F.col("d") != 0, F.col("pos")))
    return rows.groupBy(key, "industry_code").agg(F.max("m").alias("magnitude"), F.max("c").alias("confidence"), F.coalesce(first, F.lit(0)).alias("direction"))


def transmission_agg(factors: DataFrame, cells: DataFrame, key: str = "response_id") -> DataFrame:
    """Net signal, strongest factor, cross-industry dispersion and coverage per event."""
    f = factors.groupBy(key).agg(F.sum("factor").alias("net_signal"), F.max_by("factor", F.struct(F.abs("factor"), "entity")).alias("event_strength"))
    score = F.col("direction") * F.col("magnitude") * F.col("confidence")
    c = cells.groupBy(key).agg(F.when(F.count("*") >= 2, F.stddev_pop(score)).otherwise(0.0).alias("dispersion"), F.count_if(F.col("direction") != 0).alias("coverage"))
    return f.join(c, key, "left").withColumn("net_direction", F.signum(F.round("net_signal", 12)).cast("int"))


def text_factors(events: DataFrame, pos: Sequence[str] = T.POSITIVE_TERMS, neg: Sequence[str] = T.NEGATIVE_TERMS, text: str = "text") -> DataFrame:
    """Signed keyword factors of a text: up to three rows, none without a hit."""
    e = events.withColumns({"_p": hits(F.col(text), pos), "_n": hits(F.col(text), neg)}).filter("_p > 0 or _n > 0")
    top = F.greatest("_p", "_n")
    mag = F.when(top >= 3, 0.9).when(top >= 2, 0.55).otherwise(0.30)
    mixed = F.col("_p") == F.col("_n")
    conf = F.when(mixed, 0.40).otherwise(0.70)

    def row(name, value, c, sign, when):
        return F.when(when, F.struct(F.lit(name).alias("name"), value.alias("value"), c.alias("confidence"), F.lit(sign).alias("direction")))

    rows = F.array(row("text_positive", mag, conf, "+", F.col("_p") > 0), row("text_negative", mag, conf, "-", F.col("_n") > 0),
                   row("text_mixed", F.lit(0.2), F.lit(0.35), "+", mixed))
    out = e.select(*events.columns, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("f"))
    signed = F.when(F.col("f.direction") == "-", -1.0).otherwise(1.0) * F.col("f.value") * F.col("f.confidence")
    return out.select(*events.columns, "f.*", signed.alias("signed_value"))


def text_direction(text: Column, hint: Column | None = None, hint_weight: int = 1, up: Sequence[str] = T.UP_WORDS, down: Sequence[str] = T.DOWN_WORDS) -> Column:
    """Direction by word count plus a weak vote of the hint; a tie falls to the hint, else '?'."""
    h = F.coalesce(hint, F.lit("")) if hint is not None and hint_weight > 0 else F.lit("")
    p = hits(text, up) + F.when(h == "+", hint_weight).otherwise(0)
    n = hits(text, down) + F.when(h == "-", hint_weight).otherwise(0)
    return F.when(n > p, "-").when(p > n, "+").when(h.isin("+", "-"), h).otherwise("?")


def text_magnitude(text: Column, words=T.MAGNITUDE_WORDS, default: str = "未知") -> Column:
    out = None
    for label, ws in words:
        c = hits(text, ws) > 0
        out = F.when(c, label) if out is None else out.when(c, label)
    return out.otherwise(default)


def text_confidence(text: Column, label: str = "置信度[：:]") -> Column:
    named, any_ = F.regexp_extract(text, label + r"\s*(0\.\d+|1\.0)", 1), F.regexp_extract(text, r"(0\.\d+)", 1)
    return F.when(named != "", named.cast("double")).when(any_ != "", any_.cast("double")).otherwise(0.5)


def _signal(d: Column, j: Column, magnitudes: dict[str, float]) -> tuple[Column, Column, Column]:
    conf = clip(F.coalesce(F.expr("try_cast(_j.confidence as double)"), F.lit(0.5)), 0, 1)
    mag = _lookup(F.trim(F.coalesce(j["magnitude"], F.lit(""))), magnitudes, 0.5)
    return conf, mag, F.when(d == "+", 1.0).when(d == "-", -1.0) * mag * conf


def normalize_verdicts(resp: DataFrame, threshold: float = 0.3, content: str = "content", magnitudes: dict[str, float] = T.VERDICT_MAGNITUDE,
                       plus: Sequence[str] = ("+", "涨", "利好"), minus: Sequence[str] = ("-", "跌", "利空"), veto: str = "跌") -> DataFrame:
    """Verdict JSON, or marks in the first sixty characters; contested, weak or unreadable ones abstain."""
    df = resp.withColumn("_j", F.from_json(json_part(F.col(content)), VERDICT))
    head = F.substring(content, 1, 60)
    marks = F.when((hits(head, plus) > 0) & ~head.contains(veto), "+").when(hits(head, minus) > 0, "-")
    d = F.trim(F.col("_j.direction"))
    df = df.withColumn("direction", F.when(d.isin("+", "-"), d).otherwise(marks))
    conf, mag, sig = _signal(F.col("direction"), F.col("_j"), magnitudes)
    contested = F.lower(F.trim(F.coalesce("_j.contested", F.lit("")))).isin("true", "1", "yes")
    known = F.col("direction").isNotNull()
    df = df.withColumns({"confidence": F.when(known, conf), "magnitude": F.when(known, mag), "contested": known & contested, "committed_signal": F.coalesce(sig, F.lit(0.0))})
    df = df.withColumn("abstained", ~known | F.col("contested") | (F.col("confidence") < threshold))
    return df.withColumn("signal", F.when(F.col("abstained"), 0.0).otherwise(F.col("committed_signal"))).drop("_j")


def normalize_reldecomp(resp: DataFrame, content: str = "content", magnitudes: dict[str, float] = T.VERDICT_MAGNITUDE) -> DataFrame:
    """Beats-market answers; a missing one follows from opposite industry and market signs."""
    df = resp.withColumn("_j", F.from_json(json_part(F.col(content)), RELDECOMP))
    b, ri, rm = F.trim(F.col("_j.beats_market")), F.col("_j.r_ind"), F.col("_j.r_mkt")
    df = df.withColumn("beats_market", F.when(b.isin("+", "-"), b).when((ri == "+") & (rm == "-"), "+").when((ri == "-") & (rm == "+"), "-"))
    conf, mag, sig = _signal(F.col("beats_market"), F.col("_j"), magnitudes)
    known = F.col("beats_market").isNotNull()
    return df.withColumns({"confidence": F.when(known, conf), "signal": F.coalesce(sig, F.lit(0.0)), "differs": F.when(known, ~ri.eqNullSafe(rm))}).drop("_j")


def parse_direction(text: Column, plus: Sequence[str] = T.PLUS_MARKS, minus: Sequence[str] = T.MINUS_MARKS, plus_word: str = "positive", minus_word: str = "negative") -> Column:
    """One-token direction: marks in the first 30 characters, then mark counts, plus on a tie."""
    t = F.trim(text)
    head = F.substring(t, 1, 30)

    def count(ms):
        return sum(((F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))) / len(m) for m in ms), F.lit(0))

    return (F.when((hits(head, plus) > 0) | F.lower(head).contains(plus_word), "+").when((hits(head, minus) > 0) | F.lower(head).contains(minus_word), "-")
            .when(count(plus) >= count(minus), "+").otherwise("-"))


def factor_balance(factors: DataFrame, keys: Sequence[str], signed: str = "signed_value") -> DataFrame:
    """Bull and bear totals, their net, and disagreement twice the smaller share."""
    b, r = F.sum(F.greatest(signed, F.lit(0.0))), F.sum(F.greatest(-F.col(signed), F.lit(0.0)))
    g = factors.groupBy(*keys).agg(b.alias("bull"), r.alias("bear"))
    tot = F.col("bull") + F.col("bear")
    return g.withColumns({"net": F.col("bull") - F.col("bear"), "disagreement": F.when(tot < 1e-8, 0.0).otherwise(
        F.least(F.lit(1.0), F.try_divide(2 * F.least("bull", "bear"), tot)))})


def disagreement(text_signal: Column, model_signal: Column) -> Column:
    return clip(F.abs(F.tanh(text_signal) - F.tanh(model_signal * 5.0)), 0, 1)


def momentum_prob(events: DataFrame, feat: DataFrame, lookback: int = 120, window: int = 20, scale: float | None = None) -> DataFrame:
    """Logistic of the last returns' sum, scaled by five historical deviations or a fixed value; .5 without history."""
    rows = feat.dropna(subset=["ret", "vol_chg", "volatility", "mkt_ret", "ma5_gap", "ma20_gap"])
    by = ["industry_code"]
    sig = F.sum("ret").over(trailing(by, "d", window))
    den = F.lit(scale) if scale else F.greatest((F.stddev_pop("ret").over(trailing(by, "d", lookback)) + 1e-8) * 5.0, F.lit(0.01))
    state = rows.select(*by, "d", (1 / (1 + F.exp(-3.0 * sig / den))).alias("momentum_prob"))
    return asof_join(events, state, by, "event_date", "d", ["momentum_prob"]).withColumn("momentum_prob", F.coalesce("momentum_prob", F.lit(0.5)))


VECTOR = ("disagreement", "froth", "irf_prior", "text_bull_bear", "text_net", "ts_prob_up", "ts_signal", "valuation_signal")


def fusion_vector(rows: DataFrame) -> DataFrame:
    """The eight fusion inputs with missing or not-a-number values at their neutral value."""
    return rows.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(0.5 if c == "ts_prob_up" else 0.0)) for c in VECTOR})


def raw_score(variant: str = "evaluator") -> Column:
    c = F.col
    s = 0.55 * c("ts_prob_up") + 0.10 * F.tanh("valuation_signal") + 0.10 * F.tanh("froth") + 0.10 * F.tanh("irf_prior")
    if variant == "fusion":
        s = s + 0.15 * F.tanh(c("text_bull_bear") / 1.5) - 0.15 * clip("disagreement", 0, 1)
    return clip(s, 0, 1)


def shrink_signal(net: Column, mode: str, lam: float = 0.35) -> Column:
    return {"neutral": net * (1 - lam), "fixed": net * 0.65, "zero": F.lit(0.0), "none": net}[mode]


def correct_path(paths: DataFrame, signals: DataFrame, keys: Sequence[str], scale: float = 0.02, cap: float = 0.08, floor: float = 0.55,
                 slope: float = 0.035, conflict: float = 0.3, override_cap: float = 0.03, fallback: str | None = None) -> DataFrame:
    """Shift a forecast path by a decaying signal, then once more if its first five steps
    still point against a strong signal (or the fallback direction)."""
    p = paths.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("step", "mean"))).alias("_o"))
    j = p.join(signals.select(*keys, "net_signal", "sensitivity", *([fallback] if fallback else [])), list(keys))
    j = j.withColumn("_adj", F.col("net_signal") * F.col("sensitivity"))

    def decay(i):
        return F.greatest(F.lit(floor), F.lit(1.0) - slope * i)

    j = j.withColumn("_c", clip(F.col("_adj") * scale, -cap, cap))
    j = j.withColumn("_y", F.transform("_o", lambda x, i: x["mean"] + F.col("_c") * decay(i)))
    j = j.withColumn("_m5", F.aggregate(F.slice("_y", 1, 5), F.lit(0.0), lambda a, x: a + x) / F.least(F.size("_y"), F.lit(5)))
    strong = F.abs("_adj") > conflict
    d = F.when(strong, F.when(F.col("_adj") > 0, 1).otherwise(-1))
    if fallback:
        d = d.when(F.col(fallback) == "+", 1).when(F.col(fallback) == "-", -1)
    j = j.withColumn("_d", d)
    push = F.col("_d") * (F.abs("_m5") + F.when(strong, F.abs("_adj")).otherwise(0.5) * 0.005)
    clash = F.col("_d").isNotNull() & (F.when(F.col("_m5") > 0, 1).otherwise(-1) != F.col("_d"))
    j = j.withColumn("_v", F.when(clash, clip(push, -override_cap, override_cap)).otherwise(0.0))
    return j.select(*keys, F.col("_c").alias("correction"), (F.col("_v") != 0).alias("overridden"),
                    F.posexplode(F.transform("_y", lambda y, i: y + F.col("_v") * decay(i))).alias("step", "corrected"))


def inject_ramp(rows: DataFrame, by: Sequence[str], net: str, strength: str, n: int = 10, order: str = "pos") -> DataFrame:
    """Ramp of both signals over the last n rows of each window (the last row carries them in full)."""
    w = Window.partitionBy(*by)
    size = F.count("*").over(w)
    k = F.least(F.lit(n), size)
    t = F.row_number().over(w.orderBy(order)) - (size - k)
    weight = F.when(t > 0, t / k).otherwise(0.0)
    return rows.withColumns({"net_ramp": clip(F.col(net) * weight, -2, 2), "strength_ramp": clip(F.col(strength) * weight, -2, 2)})
