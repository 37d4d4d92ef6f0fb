"""Exact duplicates by heavy-hitter split, in DataFrame operations only.

Every row is known by the SHA-256 of its whole text (after an optional normalisation). A few digests may
hold a large part of all rows; they are found and settled first, so that they never meet in a shuffle.

1. Misra-Gries. Every task keeps a frequent-items summary of TRACKED x HEAVY counters over its digests; summaries
   are merged in two steps, `FAN` groups and then one. A digest of more than 1/`HEAVY` of all rows is among
   the candidates, as the error of a summary is bounded by the rows over its counters.
2. Verified winners. A second pass over the digests counts the candidates exactly, combined on the map side,
   and finds the row that stays. Winners are those with more than 1/`HEAVY` of the rows, so at most `HEAVY`
   of them: a proven bound of HEAVY x (64 + 40) bytes for the broadcast.
3. Map-side removal. Rows of a winner's digest are judged by the broadcast table alone.
4. The remaining digests are grouped by an ordinary shuffle, which carries digests and ids, never texts;
   only groups of two or more are joined back.

Nulls: a null text counts as empty. Of equal texts the row with the largest id stays, null ids being the
smallest; of rows with that same id (repeated rows) exactly one stays. An empty table gives an empty
result. Very long texts are hashed whole. Helper columns avoid the names of the input's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.llm.common import own_name, staged

#: A digest with more than this share of the rows (one in HEAVY) is settled by broadcast.
HEAVY = 1024
#: Counters of a summary for each of the heavy digests there can be. The summary's error is below 3.5 / 10.6 of a
#: heavy digest's rows, so each one stands out by more than the error, and 2 x heavy candidates hold them all.
TRACKED = 8
#: Groups of summaries merged before the last one.
FAN = 64


def digest(text: Column, normalise: Callable[[Column], Column] | None = None) -> Column:
    """Lower-case hex SHA-256 of a text in UTF-8, null counting as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.sha2(normalise(whole) if normalise else whole, 256)


def frequent(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(digest): candidates, at most 2 x heavy, among them every digest of more than 1/heavy of the rows."""
    held = rows.groupBy((F.spark_partition_id() % FAN).alias("g")).agg(F.expr(f"approx_top_k_accumulate(digest, {TRACKED * heavy})").alias("s"))
    # Grouped by a constant, as a global aggregate would also merge an empty summary for every empty partition.
    merged = held.groupBy(F.lit("all")).agg(F.expr("approx_top_k_combine(s)").alias("s"))
    return merged.select(F.explode(F.expr(f"approx_top_k_estimate(s, {2 * heavy})")).alias("x")).select(F.col("x.item").alias("digest"))


def winners(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(digest, best, group_size): exact counts and the staying row of the frequent digests, at most `heavy` rows."""
    total = rows.count()
    if not total:
        return rows.select("digest", "best", F.lit(1).cast("long").alias("group_size")).limit(0)
    found = rows.join(F.broadcast(frequent(rows, heavy)), "digest").groupBy("digest").agg(F.max("best").alias("best"), F.count("*").alias("group_size"))
    return found.filter(F.col("group_size") * heavy > total)


def judged(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """rows (digest, best: struct of id and row) with keep (the staying row's struct) and group_size; one row for each."""
    won = F.broadcast(staged(winners(rows, heavy), "winners"))
    settled = rows.join(won.withColumnRenamed("best", "keep"), "digest")
    light = rows.join(won.select("digest"), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.max("best").alias("keep"), F.count("*").alias("group_size")).filter("group_size > 1")
    rest = light.join(groups, "digest", "left").withColumns({"keep": F.coalesce("keep", "best"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    return settled.select("digest", "best", "keep", "group_size").unionByName(rest.select("digest", "best", "keep", "group_size"))


def _stamped(docs: DataFrame, id_col: str, text_col: str, normalise, row: Column) -> DataFrame:
    return docs.select(digest(F.col(text_col), normalise).alias("digest"), F.struct(F.col(id_col).alias("id"), row.alias("row")).alias("best"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None,
               heavy: int = HEAVY) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row of docs."""
    rows = staged(_stamped(docs, id_col, text_col, normalise, F.monotonically_increasing_id()), "digests")
    out = judged(rows, heavy)
    return out.select(F.col("best.id").alias("id"), F.col("keep.id").alias("keep_id"), "group_size", (F.col("best.row") == F.col("keep.row")).alias("kept"), "digest")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None,
                 heavy: int = HEAVY) -> DataFrame:
    """The rows of docs that stay, with their own columns.

    Rows are numbered and written first, so that repeated rows are told apart. Rows of a winner are dropped on
    the map side; of the others only the numbers of those that go meet the texts.
    """
    key, mark, size = (own_name(docs.columns, c) for c in ("__row", "__digest", "__group_size"))
    stamped = staged(docs.withColumns({key: F.monotonically_increasing_id(), mark: digest(F.col(text_col), normalise)}), "rows")
    rows = stamped.select(F.col(mark).alias("digest"), F.struct(F.col(id_col).alias("id"), F.col(key).alias("row")).alias("best"))
    won = F.broadcast(staged(winners(rows, heavy), "winners"))
    named = won.select(F.col("digest").alias(mark), F.col("best.row").alias(size))
    kept = stamped.join(named, mark, "left").filter(F.col(size).isNull() | (F.col(size) == F.col(key)))
    light = rows.join(won.select("digest"), "digest", "left_anti")
    best = light.groupBy("digest").agg(F.max("best").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    gone = light.join(best, "digest").filter("best.row <> keep.row").select(F.col("best.row").alias(key))
    return kept.join(gone, key, "left_anti").select(*docs.columns)
