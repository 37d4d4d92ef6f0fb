"""Quality gates: stored responses, fusion, risk, explanations, thresholds, usage, KPI table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.operators.evaluation import selective_curve, summary
from evq.operators.graph import has_cycle


def long_metrics(row: DataFrame, module: str, names: Sequence[str]) -> DataFrame:
    """One-row aggregate to (module, metric, value) rows."""
    item = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
    return row.select(item.alias("m")).select(F.lit(module).alias("module"), "m.metric", "m.value")


def response_quality(resp: DataFrame, content: str = "content") -> DataFrame:
    """Share of responses that are a JSON object, hold a chain list, and a non-empty one."""
    text = F.trim(content)
    obj = F.try_parse_json(F.col(content)).isNotNull() & text.startswith("{")
    chain = F.get_json_object(content, "$.chain")
    ok = F.coalesce(obj & F.trim(chain).startswith("["), F.lit(False))
    full = F.coalesce(ok & (F.json_array_length(chain) > 0), F.lit(False))
    n = F.greatest(F.count("*"), F.lit(1))
    row = resp.agg((F.count_if(obj) / n).alias("json_parse_rate"), (F.count_if(ok) / n).alias("schema_valid_rate"), (F.count_if(full) / n).alias("factor_coverage"))
    return long_metrics(row, "responses", ("json_parse_rate", "schema_valid_rate", "factor_coverage"))


def fusion_quality(results: DataFrame, min_coverage: float = 0.40) -> DataFrame:
    """Full accuracy, selective accuracy (zero when too few rows commit) and coverage."""
    on, ok = ~F.col("abstain"), F.col("dir_correct").cast("double")
    n, k = F.count("*"), F.count_if(on)
    sel = F.when(k < F.greatest(F.lit(5.0), n * min_coverage), 0.0).otherwise(F.avg(F.when(on, ok)))
    row = results.agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("full_accuracy"), F.coalesce(sel, F.lit(0.0)).alias("selective_accuracy"), (k / F.greatest(n, F.lit(1))).alias("coverage"))
    return long_metrics(row, "fusion", ("full_accuracy", "selective_accuracy", "coverage"))


def risk_quality(backtest: DataFrame) -> DataFrame:
    """Share of horizons whose coverage test is not rejected at five percent."""
    row = backtest.agg(F.coalesce(F.avg((F.col("kupiec_p") >= 0.05).cast("double")), F.lit(0.0)).alias("kupiec_pass_rate"))
    return long_metrics(row, "risk", ("kupiec_pass_rate",))


def explanation_quality(entries: DataFrame, opinions: DataFrame, paths: DataFrame) -> DataFrame:
    """Evidence coverage, mention rates, confidence and cycles of an explained timeline.

    entries: (narrative, industries, triggered_event); opinions: (confidence, evidence_ids);
    paths: (source, target, evidence_ids). All long tables.
    """
    def share(c):
        return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))

    o = opinions.agg(share(F.size("evidence_ids") > 0).alias("evidence_coverage"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
    p = paths.agg(share(F.size("evidence_ids") > 0).alias("path_evidence_coverage"))
    said = F.exists("industries", lambda c: F.contains(F.col("narrative"), c))
    ev = F.coalesce(F.col("triggered_event"), F.lit("")) != ""
    e = entries.agg(share(F.coalesce(said, F.lit(False))).alias("industry_mention_rate"),
                    F.coalesce(F.avg(F.when(ev, F.contains(F.col("narrative"), F.substring("triggered_event", 1, 20)).cast("double"))), F.lit(0.0)).alias("event_mention_rate"))
    cyc = 1.0 if has_cycle(paths) else 0.0
    m = [long_metrics(o, "explanation", ("evidence_coverage", "avg_confidence")), long_metrics(p, "explanation", ("path_evidence_coverage",)),
         long_metrics(e.withColumn("cycle_rate", F.lit(cyc)), "explanation", ("industry_mention_rate", "event_mention_rate", "cycle_rate"))]
    return m[0].unionByName(m[1]).unionByName(m[2])


# fixed values: (module, metric, operator, threshold)
THRESHOLDS = (
    ("responses", "json_parse_rate", ">=", 0.90), ("responses", "schema_valid_rate", ">=", 0.85), ("responses", "factor_coverage", ">=", 0.80),
    ("fusion", "full_accuracy", ">=", 0.50), ("fusion", "selective_accuracy", ">=", 0.57), ("fusion", "coverage", ">=", 0.40),
    ("risk", "kupiec_pass_rate", ">=", 0.66),
    ("explanation", "evidence_coverage", ">=", 0.80), ("explanation", "path_evidence_coverage", ">=", 0.95), ("explanation", "industry_mention_rate", ">=", 0.90),
    ("explanation", "event_mention_rate", ">=", 0.50), ("explanation", "avg_confidence", ">=", 0.40), ("explanation", "cycle_rate", "<=", 0.10))


def evaluate_gates(metrics: DataFrame, thresholds: Sequence[tuple[str, str, str, float]] = THRESHOLDS) -> DataFrame:
    """Pass flag per metric and per module (all pass); a metric without threshold is left out."""
    t = metrics.sparkSession.createDataFrame(list(thresholds), "module string, metric string, op string, threshold double")
    j = metrics.join(t, ["module", "metric"])
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).otherwise(F.col("value") == F.col("threshold"))
    j = j.withColumn("passed", ok)
    mod = j.groupBy("module").agg(F.bool_and("passed").alias("module_passed"))
    return j.join(mod, "module")


def usage(calls: DataFrame, by: Sequence[str], chars: str = "chars", latency: str | None = None) -> DataFrame:
    """Calls, tokens (four characters each, at least one per call) and cost per provider and model."""
    tok = F.greatest(F.floor(F.col(chars) / 4), F.lit(1))
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(chars).alias("chars"), F.sum(tok).alias("tokens"), (F.sum(tok) * 1e-7).alias("cost"),
                                  *([F.avg(latency).alias("mean_latency")] if latency else []))


def kpi_table(results: DataFrame, backtest: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Direction, curve, risk and portfolio figures as (section, item, metric, value) rows."""
    def melt(df, section, item, names):
        m = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
        return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), m.alias("m")).select("section", "item", "m.metric", "m.value")

    s = summary(results).filter("scope = 'all'")
    parts = [melt(s, "direction", F.col("key"), ("n", "full_accuracy", "committed_accuracy", "coverage")),
             melt(selective_curve(results).filter("bin <= 5"), "curve", F.col("bin"), ("coverage", "accuracy", "min_confidence")),
             melt(backtest, "risk", F.col("horizon"), ("breach_rate", "kupiec_p", "pinball_loss")),
             melt(portfolio, "portfolio", F.col("horizon"), ("realized_car", "predicted_var", "hhi"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
