"""Mixing sources to target weights by iterative proportional fitting.

Token totals per (source, language, topic) cell are raked until their marginals meet the targets:
each sweep scales the cells of every source, then language, then topic to the target share. A
document is then drawn with probability ratio / max ratio, where ratio = raked weight / tokens of
its cell, so the expected tokens of the sample have the raked proportions exactly and nothing is
capped. The draw is a hash of id and seed: the same on every run and after a lost executor.

Default targets flatten the observed shares: share ** FLATTEN[dimension], normalised.
Nulls in a dimension form a value of their own (the empty string), a null text has no tokens. Rows
of a cell without tokens are never drawn. Repeated ids share one draw. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evq.llm.common import bounded_small, own_name, staged

DIMENSIONS = ("source", "lang", "topic")
FLATTEN = {"source": 0.7, "lang": 0.8, "topic": 0.8}
WORD = "[^\\x20\\x09-\\x0D]+"
SWEEPS, TOLERANCE = 32, 1e-9


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic(text: Column) -> Column:
    """Form of a text by its lines and words: list, note, article or long read. A stand-in for a topic column."""
    n, lines = tokens(text), F.regexp_count(F.coalesce(text, F.lit("")), F.lit("\n"))
    return F.when(n < 8 * lines, "list").when(n < 100, "note").when(n < 600, "article").otherwise("long")


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (source, lang, topic, tokens) with `share` (target share of all tokens), raked to (value, share) tables.

    Cells are summaries; a sweep is three window sums over them. Every fourth sweep is written.
    """
    live = cells.filter("tokens > 0")
    cur = live.crossJoin(live.agg(F.sum("tokens").alias("__all"))).withColumn("share", F.col("tokens") / F.col("__all")).drop("__all")
    for d in DIMENSIONS:
        if targets and d in targets:
            cur = cur.join(targets[d].select(F.coalesce(F.col("value"), F.lit("")).alias(d), F.col("share").cast("double").alias(f"goal_{d}")), d)
        else:
            goal = live.groupBy(d).agg(F.sum("tokens").alias("t")).select(d, F.pow(F.col("t").cast("double"), FLATTEN[d]).alias("g"))
            goal = goal.crossJoin(goal.agg(F.sum("g").alias("gs"))).select(d, (F.col("g") / F.col("gs")).alias(f"goal_{d}"))
            cur = cur.join(goal, d)
    cur = staged(cur, "cells")
    for k in range(0, sweeps, 4):
        for _ in range(min(4, sweeps - k)):
            for d in DIMENSIONS:
                cur = cur.withColumn("share", F.col("share") * F.col(f"goal_{d}") / F.sum("share").over(Window.partitionBy(d)))
        cur = staged(cur, "cells")
        off = [cur.groupBy(d).agg(F.abs(F.sum("share") / F.first(f"goal_{d}") - 1).alias("off")) for d in DIMENSIONS[:-1]]
        if max([r[0] or 0.0 for r in off[0].union(off[1]).agg(F.max("off")).collect()]) < tolerance:
            break
    return cur


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_of=topic,
        targets: dict[str, DataFrame] | None = None, seed: int = 42, sweeps: int = SWEEPS) -> DataFrame:
    """All columns of docs and a struct `mixture` (topic, tokens, share, probability, drawn)."""
    out, key = own_name(docs.columns, "mixture"), {d: own_name(docs.columns, f"__{d}") for d in (*DIMENSIONS, "tokens")}
    text = F.col(text_col)
    base = docs.withColumns({key["source"]: F.coalesce(F.col(source_col).cast("string"), F.lit("")), key["lang"]: F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
                             key["topic"]: F.coalesce(topic_of(text), F.lit("")), key["tokens"]: tokens(text)})
    cells = staged(base.groupBy(*[F.col(key[d]).alias(d) for d in DIMENSIONS]).agg(F.sum(key["tokens"]).alias("tokens")), "cell-tokens")
    raked = rake(cells, targets, sweeps)
    peak = raked.agg(F.max(F.col("share") / F.col("tokens"))).first()[0] or 1.0
    chance = bounded_small(raked.select(*[F.col(d).alias(key[d]) for d in DIMENSIONS], F.col("share").alias("__share"), (F.col("share") / F.col("tokens") / peak).alias("__p")), "chances")
    joined = base.join(chance, [key[d] for d in DIMENSIONS], "left")
    u = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    p = F.coalesce(F.col("__p"), F.lit(0.0))
    return joined.select(*[base[c] for c in docs.columns], F.struct(
        F.col(key["topic"]).alias("topic"), F.col(key["tokens"]).alias("tokens"), F.coalesce("__share", F.lit(0.0)).alias("share"), p.alias("probability"), (u < p).alias("drawn")).alias(out))
