"""Sinks: partitioned tables and replace-all edge snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write a result table; rows of one partition value are not forced into one file or task."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def per_horizon(rows: DataFrame, columns: dict[str, str], horizons: Sequence[int]) -> DataFrame:
    """Wide result columns name_T1, name_T5 ... to one row per horizon."""
    item = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"{c}_T{h}").cast("double").alias(a) for a, c in columns.items()]) for h in horizons]))
    keep = [c for c in rows.columns if not any(c == f"{b}_T{h}" for b in columns.values() for h in horizons)]
    return rows.select(*keep, item.alias("_h")).select(*keep, "_h.*")


def save_edges(edges: DataFrame, base: str, as_of: str) -> None:
    """Snapshot of all edges for a day; writing the day again replaces it."""
    edges.write.mode("overwrite").parquet(f"{base}/as_of={as_of}")


def load_edges(spark: SparkSession, base: str, as_of: str) -> DataFrame:
    return spark.read.parquet(f"{base}/as_of={as_of}")
