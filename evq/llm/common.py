"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.functions.lineage import stage

#: A table is broadcast only if its written files hold at most this many bytes; beyond it, joins shuffle.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared checkpoint folder and read back; the lineage ends there."""
    return stage(df, f"llm-{name}")


def bounded_small(df: DataFrame, name: str, row_bytes: int = 64, most: int = BROADCAST_BYTES) -> DataFrame:
    """Stage a table of summaries and hint a broadcast if rows x row_bytes stay under `most`.

    A larger table is returned without a hint, so the join shuffles and AQE may split hot keys.
    """
    kept = staged(df, name)
    return F.broadcast(kept) if kept.count() * row_bytes <= most else kept


def sliced(parts: Iterator[pa.RecordBatch], rows: int = 512, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows and about `most` bytes, so that a Python worker holds few texts at once.

    Spark bounds the bytes of a batch itself (spark.sql.execution.arrow.maxBytesPerBatch); no setting of the session is touched.
    """
    for b in parts:
        step = max(1, min(rows, b.num_rows * most // max(b.nbytes, 1)))
        for i in range(0, max(b.num_rows, 1), step):
            yield b.slice(i, step)


def own_name(columns: list[str], base: str) -> str:
    """A column name that clashes with none of `columns` (compared without case)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = "_" + base
    return base
