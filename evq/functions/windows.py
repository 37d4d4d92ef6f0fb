"""Physical patterns shared by the event-keyed operators.

Each keeps a window group no longer than the number of distinct dates per key:
rows are first aggregated (or made distinct) per key and date, so a key that owns
a third of all rows still meets its window as at most one row per date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.functions.sizing import settled


def past_totals(
    df: DataFrame, by: Sequence[str], on: str, totals: dict[str, Column], inclusive: bool = False
) -> DataFrame:
    """Totals over all strictly earlier dates, one row per (by, on).

    `totals` maps a name to a summed expression. The per-date aggregation combines
    map-side; only date-grain rows reach the window.
    """
    daily = df.groupBy(*by, on).agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(on)
    w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return daily.select(*by, on, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in totals])


def asof_join(
    probes: DataFrame,
    facts: DataFrame,
    by: Sequence[str],
    probe_on: str,
    fact_on: str,
    payload: Sequence[str],
    direction: str = "backward",
    strict: bool = True,
    fact_date: str | None = None,
    how: str = "left",
    settle: bool = False,
) -> DataFrame:
    """As-of join by union and fill: linear, no range join.

    backward+strict takes the last fact with fact_on < probe_on, forward non-strict the
    first fact with fact_on >= probe_on. Probes are made distinct per (by, date) before
    the window and joined back by equality, so a hot key is split by the join, not
    gathered in a window. Facts must be unique per (by, fact_on). settle materialises the
    per-key result first and broadcasts it if small; worth it when the probes are many.
    """
    by = list(by)
    fields = [F.col(c) for c in payload] + ([F.col(fact_on).alias(fact_date)] if fact_date else [])
    names = list(payload) + ([fact_date] if fact_date else [])
    state = F.struct(*fields)
    back = direction == "backward"
    # at an equal date the fact sorts after the probe when it must stay hidden
    fact_first = (not strict) if back else strict
    left = probes.select(*by, F.col(probe_on).alias("_t")).distinct()
    marks = left.select(*by, "_t", F.lit(1 if fact_first else 0).alias("_k"), F.lit(None).cast(
        facts.select(state.alias("s")).schema["s"].dataType).alias("_s"))
    rows = facts.select(*by, F.col(fact_on).alias("_t"), F.lit(0 if fact_first else 1).alias("_k"), state.alias("_s"))
    # a running last in either direction is linear
    order = ["_t", "_k"] if back else [F.desc("_t"), F.desc("_k")]
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*order)
    filled = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = marks.withColumn("_m", F.lit(True)).unionByName(rows.withColumn("_m", F.lit(False)))
    found = (
        both.withColumn("_f", filled).filter("_m")
        .select(*by, F.col("_t").alias(probe_on), *[F.col("_f")[n].alias(n) for n in names], F.col("_f").isNotNull().alias("_hit"))
    )
    out = probes.join(settled(found) if settle else found, [*by, probe_on], "left" if how == "left" else "inner")
    return (out if how == "left" else out.filter("_hit")).drop("_hit")


def full_window(agg: Column, counted: Column, n: int) -> Column:
    """Rolling value only where the frame holds n non-null inputs."""
    return F.when(counted == n, agg)


def trailing(by: Sequence[str], on: str, n: int | None):
    """Window over the last n rows including the current one (all earlier rows if n is None)."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(on)
    return w.rowsBetween(Window.unboundedPreceding if n is None else -(n - 1), 0)
