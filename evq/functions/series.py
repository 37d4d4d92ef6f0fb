"""Column functions over one sorted or date-ordered array per series.

A series has at most one value per trading day, so its array is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a).cast("double"))


def variance(a: Column, m: Column, ddof: int) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)), (F.size(a) - ddof).cast("double"))


def quantile(a: Column, p: float) -> Column:
    """Linear interpolation on an ascending array."""
    pos = (F.size(a) - 1) * F.lit(p)
    i = F.floor(pos).cast("int")
    j = F.least(i + 1, F.size(a) - 1)
    return F.when(F.size(a) > 0, F.get(a, i) + (pos - i) * (F.get(a, j) - F.get(a, i)))


def tail_mean(a: Column, at: Column) -> Column:
    return F.coalesce(mean(F.filter(a, lambda x: x <= at)), at)


def drawdown(nav: Column, floor: float = 1.0, eps: float = 0.0) -> Column:
    """Largest (peak - nav) / peak with the running peak starting at `floor`."""
    zero = F.struct(F.lit(floor).alias("peak"), F.lit(0.0).alias("dd"))

    def step(s, x):
        peak = F.greatest(s["peak"], x)
        return F.struct(peak.alias("peak"), F.greatest(s["dd"], (peak - x) / (peak + eps)).alias("dd"))

    return F.aggregate(nav, zero, step, lambda s: s["dd"])


def running(a: Column) -> Column:
    """Cumulative sums of an array."""
    zero = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("o"))
    return F.aggregate(a, zero, lambda st, x: F.struct((st["s"] + x).alias("s"), F.concat(st["o"], F.array(st["s"] + x)).alias("o")),
                       lambda st: st["o"])
