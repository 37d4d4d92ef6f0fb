"""Streaming forms of the tick operators, run to completion over available files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evq.functions.lineage import shared_folder, stage
from evq.functions.ordered import lay_out
from evq.operators.asof import visibility_run, visible_at
from evq.operators.ticks import tick_windows


def file_stream(spark: SparkSession, folder: str, schema, name: str, per_trigger: int | None = None) -> DataFrame:
    """Files of one table in a folder as a stream."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).parquet(folder)


def run_available(stream: DataFrame, mode: str = "append", batch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process everything available, write each batch to Parquet, return the written table.

    With `batch`, each micro-batch is transformed by a batch operator first. A batch is
    written under its id with overwrite, so a replay after a failure leaves one copy.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:8]}"
    # a batch operator's schema is that of its result on no rows, so an empty stream has one too
    shape = (batch(spark.createDataFrame([], stream.schema)) if batch else stream).schema

    def sink(df: DataFrame, epoch: int) -> None:
        out = batch(df) if batch else df
        out.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    wrote = q.lastProgress is not None and any(p["numInputRows"] for p in q.recentProgress)
    return spark.read.schema(shape).parquet(f"{base}/out").drop("epoch") if wrote else spark.createDataFrame([], shape)


def stream_windows(src: DataFrame, kind: str, watermark: str, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Event-time windows of a tick stream; rows later than the watermark are dropped."""
    return tick_windows(src.withWatermark("ts", watermark), kind, size, slide)


def stream_visible(src: DataFrame, docs: DataFrame) -> DataFrame:
    """Each micro-batch of ticks with the number of documents visible on its date.

    The documents are counted once: their running count by date is a table of at most a calendar,
    which every micro-batch reads.
    """
    run, total = visibility_run(docs)
    run = stage(run, "visible-run")
    t = src.withColumn("event_date", F.to_date("ts"))
    return run_available(t, batch=lambda df: visible_at(df, run, total))


def run_carrying(stream: DataFrame, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], state: DataFrame) -> DataFrame:
    """As run_available, with a table carried from batch to batch: step(rows, state) gives (result, next state).

    state is the one before the first batch. Each state is written under its batch's id, so a replay reads the one before.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:8]}"
    shape = step(spark.createDataFrame([], stream.schema), state)[0].schema
    states = {-1: state}

    def sink(df: DataFrame, epoch: int) -> None:
        out, after = step(df, states[max(k for k in states if k < epoch)])
        out.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")
        after.write.mode("overwrite").parquet(f"{base}/carried/epoch={epoch}")
        states[epoch] = spark.read.schema(state.schema).parquet(f"{base}/carried/epoch={epoch}")

    stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return spark.read.schema(shape).parquet(f"{base}/out").drop("epoch") if len(states) > 1 else spark.createDataFrame([], shape)


def monitored(rows: DataFrame, key: str, threshold: float, window: int, coverage_window: int, min_coverage: float) -> tuple[DataFrame, DataFrame]:
    """(key, seq, reason) of the rows not marked `old`, and the last rows of every key that later windows reach back to.

    Rows are range-partitioned by (key, seq), so a key of any size is cut into slices. A slice takes over the last
    rows of the slices before it, which are a few for each slice, and its windows run inside the slice.
    """
    reach = max(window, coverage_window) - 1
    laid = lay_out(rows.select(key, "seq", F.abs("residual").alias("a"), F.col("in_interval").cast("int").alias("i"), "old"), [key], ["seq"])
    row = F.struct("seq", "a", "i")
    latest = Window.partitionBy(key, "_p").orderBy(F.desc("seq"))
    ends = laid.withColumn("_k", F.row_number().over(latest)).filter(F.col("_k") <= reach).groupBy(key, "_p").agg(F.sort_array(F.collect_list(row)).alias("end"))
    before = Window.partitionBy(key).orderBy("_p")
    last = lambda x: F.slice(x, F.greatest(F.size(x) - reach + 1, F.lit(1)), F.lit(reach))
    halo = ends.withColumn("_b", F.flatten(F.collect_list("end").over(before.rowsBetween(-reach, -1)))).select(key, "_p", F.inline(last(F.col("_b"))))
    w = Window.partitionBy(key, "_p").orderBy("seq")
    both = laid.withColumn("own", ~F.col("old")).drop("old").unionByName(halo.withColumn("own", F.lit(False)))
    n = F.row_number().over(w)
    near, far = F.sum("a").over(w.rowsBetween(-(window - 1), 0)) / window, F.sum("i").over(w.rowsBetween(-(coverage_window - 1), 0)) / coverage_window
    reason = F.when((n >= window) & (near > threshold), "residual").when((n >= coverage_window) & (far < min_coverage), "coverage")
    out = both.select(key, F.col("seq").cast("long").alias("seq"), reason.alias("reason"), "own").filter("own").drop("own")
    whole = ends.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_p", "end"))).alias("e"))
    after = whole.select(key, F.inline(last(F.flatten(F.transform(F.slice("e", F.greatest(F.size("e") - reach + 1, F.lit(1)), F.lit(reach)), lambda x: x["end"])))))
    return out, after


def residual_monitor_stream(src: DataFrame, key: str, threshold: float, window: int = 5, coverage_window: int = 20, min_coverage: float = 0.70) -> DataFrame:
    """Monitor of a stream (key, seq, residual, in_interval): reason of every row, run over all available batches.

    Rows of a micro-batch are taken in seq order within a key; the state is the last rows of every key that later
    windows reach back to, as a written table.
    """
    kind = dict(src.dtypes)
    state = src.sparkSession.createDataFrame([], f"`{key}` {kind[key]}, seq {kind['seq']}, a {kind['residual']}, i int")

    def step(rows: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        old = held.select(key, "seq", F.col("a").alias("residual"), F.col("i").cast("boolean").alias("in_interval"), F.lit(True).alias("old"))
        out, after = monitored(rows.select(key, "seq", "residual", "in_interval", F.lit(False).alias("old")).unionByName(old), key, threshold, window, coverage_window, min_coverage)
        return out, after.select(key, "seq", "a", "i")

    return run_carrying(src, step, state)
