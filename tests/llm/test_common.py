"""Arrow batches are cut inside the operators; the session keeps its settings."""
import pyarrow as pa

from evq.llm import warc
from evq.llm.common import sliced

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_slices_hold_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array([str(i) * 50 for i in range(1000)]), pa.array([[i] * (i % 3) for i in range(1000)])], names=["t", "l"])
    for rows, most in ((64, 1 << 20), (1 << 20, 4096), (1, 1), (5000, 1 << 30)):
        parts = list(sliced(iter([b]), rows, most))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b])) and max(p.num_rows for p in parts) <= rows
    empty = list(sliced(iter([b.slice(0, 0)])))
    assert len(empty) == 1 and empty[0].num_rows == 0


def test_settings_stay(spark, sf):
    before = spark.conf.get(KEY)
    warc.archive(spark.read.parquet(f"{sf}/pages.parquet")).count()
    assert spark.conf.get(KEY) == before
