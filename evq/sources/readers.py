"""Readers with explicit schemas and the typed normalisation behind them.

Each reader is a scan plus a pure DataFrame function, so the same normalisation serves
raw tables that are already loaded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PANEL_RAW = "industry_code string, industry_name string, trade_date string, open double, high double, low double, close double, volume double, amount double"
VALUATION = "date date, industry_code string, pe_ttm double, pb double, dividend_yield double"
MARGIN = "date date, sse_fin double, szse_fin double, total_fin double"
RATES = "date date, LPR1Y double, LPR5Y double, RATE_1 double, RATE_2 double"
EVENTS_RAW = "event_date string, event_type string, event_name string, affected_industries string, direction string, magnitude string, description string"
DOCUMENTS_RAW = ("chunk_id string, event_date string, event_tag string, doc_type string, source string, pub_date string, text string, "
                 "entities array<string>, undated_origin boolean, valid_from string")
# fixed values: name fragments that mark a date or a closing-price column
DATE_NAMES = ("date", "日期", "time")
CLOSE_NAMES = ("close", "收盘")


def read_panel(spark: SparkSession, path, fmt: str = "csv", schema: str = PANEL_RAW) -> DataFrame:
    """Price panel: code as string, date parsed, bad prices null."""
    r = spark.read.schema(schema)
    raw = r.option("header", True).csv(path) if fmt == "csv" else r.format(fmt).load(path)
    return typed_panel(raw)


def typed_panel(raw: DataFrame) -> DataFrame:
    d = F.coalesce(F.try_to_date("trade_date", "yyyy-MM-dd"), F.try_to_date("trade_date", "yyyyMMdd"))
    return raw.withColumns({"industry_code": F.col("industry_code").cast("string"), "d": d, "close": F.expr("try_cast(close as double)"),
                            "volume": F.expr("try_cast(volume as double)")}).filter("d is not null").drop("trade_date")


def normalize_columns(df: DataFrame, dates: Sequence[str] = DATE_NAMES, closes: Sequence[str] = CLOSE_NAMES) -> DataFrame:
    """Find the date and close columns by name fragments; first column and first numeric column otherwise."""
    def find(frags):
        return next((c for c in df.columns if any(f in c.lower() for f in frags)), None)

    d = find(dates) or df.columns[0]
    c = find(closes) or next(n for n, t in df.dtypes if n != d and t in ("double", "float", "int", "bigint"))
    day = F.col(d).cast("date") if dict(df.dtypes)[d] != "string" else F.try_to_date(d)
    return df.select(day.alias("d"), F.expr(f"try_cast(`{c}` as double)").alias("close"))


def read_optional(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """A side table that may be missing: an empty table of the same schema then."""
    try:
        r = spark.read.schema(schema)
        return r.option("header", True).csv(path) if fmt == "csv" else r.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def split_list(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, "﻿", ""), "[,，;；\\s]+"), lambda x: F.trim(x) != "")


def read_events(spark: SparkSession, path, schema: str = EVENTS_RAW) -> DataFrame:
    """Event library CSV with BOM and comment rows; the industry list becomes an array."""
    return typed_events(spark.read.schema(schema).option("header", True).option("comment", "#").option("encoding", "UTF-8").csv(path))


def typed_events(raw: DataFrame) -> DataFrame:
    d = F.try_to_date(F.substring(F.regexp_replace("event_date", "﻿", ""), 1, 10))
    return raw.withColumns({"event_date": d, "affected_industries": split_list(F.col("affected_industries"))}).filter("event_date is not null")


def read_documents(spark: SparkSession, path, lines: bool = True) -> DataFrame:
    """Document library. JSON lines split across tasks; lines=False reads a single JSON array file."""
    return typed_documents(spark.read.schema(DOCUMENTS_RAW).option("multiLine", not lines).json(path))


def typed_documents(raw: DataFrame) -> DataFrame:
    """Publication day falls back to the event day; an unreadable one is 1970-01-01 in pub_time and null in pub_date."""
    text = F.coalesce(F.nullif("pub_date", F.lit("")), F.nullif("event_date", F.lit("")))
    d = F.try_to_date(text, "yyyy-MM-dd")
    meta = F.map_from_arrays(F.array(F.lit("event_date"), F.lit("event_tag"), F.lit("doc_type")), F.array(*[F.coalesce(c, F.lit("")) for c in ("event_date", "event_tag", "doc_type")]))
    return raw.select(F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("未知")).alias("source"),
                      d.alias("pub_date"), F.coalesce(d.cast("timestamp"), F.lit("1970-01-01").cast("timestamp")).alias("pub_time"),
                      F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.try_to_date("valid_from", "yyyy-MM-dd").alias("valid_from"), meta.alias("metadata"))


PRIOR_JSON = "map<string,map<string,struct<industry_name:string,direction:int,strength:double,verified_agree:boolean>>>"


def read_priors(spark: SparkSession, path) -> DataFrame:
    """Nested prior JSON to one row per (event_type, industry)."""
    return flat_priors(spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.priors").alias("priors")))


def flat_priors(raw: DataFrame) -> DataFrame:
    cells = raw.select(F.explode(F.from_json("priors", PRIOR_JSON)).alias("event_type", "c"))
    rows = cells.select("event_type", F.explode("c").alias("industry_code", "p"))
    d, s = F.coalesce("p.direction", F.lit(0)), F.coalesce("p.strength", F.lit(0.0))
    return rows.select("event_type", "industry_code", d.alias("direction"), s.alias("strength"), (d * s).alias("signed_strength"), F.coalesce("p.verified_agree", F.lit(True)).alias("verified_agree"))


def read_results(spark: SparkSession, paths: Sequence[str], schema: str | None = None) -> DataFrame:
    """Result files whose columns drift: missing ones are null, the file name is kept."""
    out = None
    for p in paths:
        r = spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)
        one = r.option("header", True).csv(p).withColumn("file", F.input_file_name())
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def pred_col(df: DataFrame, base: str, horizon: int) -> Column:
    """Horizon-specific column, else the legacy column for horizon five, else null."""
    names = [f"{base}_T{horizon}"] + ([base] if horizon == 5 else [])
    have = [F.col(n).cast("double") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("double")


def latest_runs(rows: DataFrame, min_rows: int, tag: str = "tag", run: str = "run", exclude: str | None = None) -> DataFrame:
    """Newest run of each tag with at least min_rows rows; runs matching `exclude` are left out."""
    kept = rows if exclude is None else rows.filter(~F.col(run).rlike(exclude))
    n = kept.groupBy(tag, run).agg(F.count("*").alias("n")).filter(F.col("n") >= min_rows)
    w = Window.partitionBy(tag).orderBy(F.desc(run))
    return n.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def pending(targets: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return targets.join(done.select(*keys).distinct(), list(keys), "left_anti")


def merge_years(parts: Sequence[DataFrame], codes: dict[str, str], rename: dict[str, str] | None = None) -> DataFrame:
    """Yearly files together: known codes only, named, one row per (date, code)."""
    out = None
    for p in parts:
        p = p.withColumnsRenamed(rename or {})
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    names = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    kept = out.filter(F.col("industry_code").isin(list(codes))).withColumn("industry_name", names[F.col("industry_code")])
    return dedupe(kept, ["date", "industry_code"], ["pe_ttm", "pb"])


def margin_total(a: DataFrame, b: DataFrame) -> DataFrame:
    """First exchange joined to the second, which is carried forward; total counts a missing second as zero."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    j = a.join(b, "date", "left").withColumn("szse_fin", F.last("szse_fin", True).over(w))
    return j.withColumn("total_fin", F.col("sse_fin") + F.coalesce("szse_fin", F.lit(0.0)))


def load_responses(spark: SparkSession, path) -> DataFrame:
    """Stored responses: one JSON object that maps a key to a record with content."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<content:string,model:string,provider:string>>")).alias("response_id", "r")).select("response_id", "r.*")


def response_lines(rows: DataFrame, content: str = "value") -> DataFrame:
    """The same from rows that each hold a small JSON map."""
    return rows.select(F.explode(F.from_json(content, "map<string,struct<content:string>>")).alias("response_id", "r")).select("response_id", "r.content")


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by `order` (a partial aggregate, deterministic)."""
    cols = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.*")
