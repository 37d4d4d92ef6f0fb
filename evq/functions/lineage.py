"""Cutting lineage in ways that survive executor loss."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder named by the session's spark.checkpoint.dir, else one below the session's warehouse."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    return known or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def _checkpoints(spark: SparkSession) -> str:
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        # The folder is this application's own and goes when it ends.
        path = spark._jvm.org.apache.hadoop.fs.Path(held.get())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return held.get()


def folder(spark: SparkSession, name: str) -> str:
    """Path of a new, unused folder for files of this session."""
    return f"{_checkpoints(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: columnar, prunable, with real sizes."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `stage` wrote, once no later action reads it."""
    spark = df.sparkSession
    top = f"{_checkpoints(spark)}/tables/"
    for name in {f[:f.index("/", f.index("/tables/") + len("/tables/"))] for f in df.inputFiles() if "/tables/" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.makeQualified(path).toString().startswith(fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(top)).toString()):
            fs.delete(path, True)
