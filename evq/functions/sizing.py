"""Broadcast hints behind a measured size in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.functions.lineage import cut

MAX_BYTES = 48 << 20


def written_bytes(df: DataFrame) -> int:
    """Bytes of the rows as JSON text, which no type's binary form exceeds by much; a distributed sum."""
    return df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))).first()[0] or 0


def small(df: DataFrame, counted: DataFrame | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Hint a broadcast when `counted` (default: the table itself) holds at most max_bytes.

    `counted` must bound the table's size and be materialised (a checkpoint or written table), so
    that measuring reads it and computes nothing twice. A larger table is returned without hint
    and joins by shuffle.
    """
    return F.broadcast(df) if written_bytes(df if counted is None else counted) <= max_bytes else df


def settled(df: DataFrame) -> DataFrame:
    """Materialise a table bounded by keys and dates, then hint a broadcast if it is small.

    Joined to scenario rows, it saves the shuffle of the large side: without the known
    size both sides would be exchanged before the small one turns out to be small.
    """
    return small(cut(df))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table of few splits over all cores; a table with a split for each core stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
