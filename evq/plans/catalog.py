"""Registry of queries and oracles. An oracle is written apart from the Spark form."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evq.sources.sample import Sample, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("events", "asof", "features", "risk", "portfolio", "evaluation", "priors", "signals", "models", "retrieval",
           "graph", "quality", "ticks", "sources")


def query(name: str, sql: str | None = None):
    """Register fn(s: Sample) -> DataFrame under `name`, with DuckDB SQL over the sample views."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Sample.of(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"evq.plans.{m}_queries")
