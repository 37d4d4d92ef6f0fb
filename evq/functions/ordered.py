"""Rank, lag and quantile over long ordered groups without gathering a group in one task.

Rows are range-partitioned on (group, order key), so a group with a third of all rows
spans many partitions; only per-partition summaries are combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evq.functions.lineage import cut


def lay_out(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """Fixed range layout with its partition id in _p (checkpointed, so it is read, not redone)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *by, *order).withColumn("_p", F.spark_partition_id()))


def ordered_rank(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "rn", total: str | None = None) -> DataFrame:
    """Exact row number per group over a total order, and the group size if asked."""
    laid = lay_out(df, by, order)
    sizes = laid.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    before = w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(w).alias(total or "_n"))
    local = laid.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(*order)))
    out = local.join(offsets, [*by, "_p"]).withColumn(name, F.col("_r") + F.col("_o"))
    return out.drop("_p", "_r", "_o", *([] if total else ["_n"]))


def ordered_lag(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "prev") -> DataFrame:
    """Previous row's value per group over a total order; null on a group's first row."""
    laid = lay_out(df, by, order)
    w = Window.partitionBy(*by, "_p").orderBy(*order)
    local = laid.withColumns({name: F.lag(value).over(w), "_first": F.row_number().over(w) == 1})
    last = laid.groupBy(*by, "_p").agg(F.max_by(value, F.struct(*order)).alias("_v"))
    g = Window.partitionBy(*by) if by else Window.partitionBy()
    carry = last.select(*by, "_p", F.lag("_v").over(g.orderBy("_p")).alias("_carry"))
    out = local.join(carry, [*by, "_p"])
    return out.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(name))).drop("_p", "_first", "_carry")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group; equal values are counted before the sort."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    laid = lay_out(counts, by, ["_v"])
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    sizes = laid.groupBy(*by, "_p").agg(F.sum("_k").alias("_c"))
    before = w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(w).alias("_n"))
    run = Window.partitionBy(*by, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = laid.withColumn("_hi", F.sum("_k").over(run)).join(offsets, [*by, "_p"])
    hi = F.col("_o") + F.col("_hi")
    lo = hi - F.col("_k")
    picks, out = [], []
    for n, q in qs.items():
        pos = (F.col("_n") - 1) * q
        a = F.floor(pos)
        b = F.least(a + 1, F.col("_n") - 1)
        picks += [F.max(F.when((lo <= a) & (a < hi), F.col("_v"))).alias(f"_{n}a"), F.max(F.when((lo <= b) & (b < hi), F.col("_v"))).alias(f"_{n}b"),
                  F.max(pos - a).alias(f"_{n}f")]
        out.append((F.col(f"_{n}a") + F.col(f"_{n}f") * (F.col(f"_{n}b") - F.col(f"_{n}a"))).alias(n))
    return rows.groupBy(*by).agg(*picks).select(*by, *out)
