"""Merkle dataset manifest: a tree of SHA-256 over all rows, with an inclusion proof for each.

Every row is a leaf. The leaves of a group (a column such as the language) ascend by id; every eight
consecutive nodes become one parent until one is left, the group's subroot. The subroots, in order of
the group, form a tree of their own, whose last node is the root.

Concatenated-level strings. A *block* is an aligned run of at most 512 nodes, three levels of the tree.
Its lowest level is one string of hex digests, 64 characters each. SQL cuts that string into pieces of
512 characters and hashes each, which gives the next level as a string again. The siblings of node i on
a level are the flanking substrings within its piece of 512. The tops of the blocks are the nodes of the
next round, until every group has one node; then the subroots climb in the same way. From the root down,
each round's steps are joined to the blocks below it by (group, position), one row for each block.

Positions come from a range layout over (group, id), so a group with any part of the rows spreads over
tasks, and no task holds more than a block of one group at once. What is shuffled are digests; texts are
read once, where leaves are hashed.

Nulls: every field of a leaf is `-` if null, else its UTF-8 byte count, `:` and its value, so null and empty
text differ. A null group is a group of its own and comes first; null ids come first in their group. Rows of
one id are ordered by their leaf, repeated rows are leaves of their own. An empty table has no root and gives
an empty result. Further columns of the leaves table are carried along; helper columns avoid their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.functions.ordered import ordered_rank
from evq.llm.common import own_name, staged

FAN = 8
#: Characters of a digest and of the digests of one parent's children.
HEX = 64
RUN = FAN * HEX
#: Levels and nodes of a block.
DEPTH = 3
BLOCK = FAN**DEPTH


def field(value: Column) -> Column:
    """One field of a leaf as text: `-`, or byte count, colon and value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Digest of a row of values."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _parents(level: Column) -> Column:
    """The next level of a level string (as bytes)."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * RUN + 1, F.lit(RUN)), 256)), "").cast("binary")


def _round(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Blocks (key, pos, n, levels, l0, l1, l2, top, members) of nodes (key, pos, n, node, carried columns).

    pos counts from 0 within a key and n is the number of the key's nodes; members hold the carried columns in order.
    """
    grouped = nodes.groupBy("key", "n", F.floor(F.col("pos") / BLOCK).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "node", *carried))).alias("members"))
    levels = F.when(F.col("n") <= 1, 0).when(F.col("n") <= FAN, 1).when(F.col("n") <= FAN * FAN, 2).otherwise(DEPTH)
    held = grouped.select("key", F.col("block").alias("pos"), "n", levels.alias("levels"), F.array_join(F.col("members.node"), "").cast("binary").alias("l0"),
                          F.transform("members", lambda m: F.struct(m["pos"].alias("pos"), *[m[c].alias(c) for c in carried])).alias("members"))
    held = held.withColumn("l1", F.when(F.col("levels") >= 1, _parents(F.col("l0"))))
    held = held.withColumn("l2", F.when(F.col("levels") >= 2, _parents(F.col("l1"))))
    top = F.when(F.col("levels") == 0, F.col("l0")).when(F.col("levels") == 1, F.col("l1")).when(F.col("levels") == 2, F.col("l2")).otherwise(_parents(F.col("l2")))
    return staged(held.withColumn("top", top.cast("string")), "merkle-blocks")


def _climb(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """The rounds of blocks from the nodes up to one block for each key."""
    rounds = [_round(nodes, carried)]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        up = rounds[-1].select("key", "pos", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("top").alias("node"))
        rounds.append(_round(up, []))
    return rounds


def _steps(blocks: DataFrame, carried: list[str]) -> DataFrame:
    """(key, pos, node, steps, carried columns) of every node; blocks have the steps above them in `above`."""
    def step(k: int, i: Column) -> Column:
        level, at = F.col(f"l{k}"), F.floor(i / FAN**k).cast("int")
        start = at - at % FAN
        return F.struct(F.substring(level, start * HEX + 1, (at - start) * HEX).cast("string").alias("left"),
                        F.substring(level, (at + 1) * HEX + 1, (start + FAN - 1 - at) * HEX).cast("string").alias("right"))

    def told(m: Column, i: Column) -> Column:
        own = F.slice(F.array(*[step(k, i) for k in range(DEPTH)]), F.lit(1), F.col("levels"))
        return F.struct(m["pos"].alias("pos"), F.substring("l0", i * HEX + 1, F.lit(HEX)).cast("string").alias("node"), F.concat(own, F.col("above")).alias("steps"), *[m[c].alias(c) for c in carried])

    return blocks.select("key", F.explode(F.transform("members", told)).alias("m")).select("key", "m.*")


def _descend(rounds: list[DataFrame], tops: DataFrame, carried: list[str], told: list[str]) -> DataFrame:
    """Steps of the lowest round's nodes; tops: (key, pos = 0, above, told columns) of the highest blocks. told go down to every node."""
    above = tops
    for k in range(len(rounds) - 1, -1, -1):
        blocks = rounds[k].join(above, ["key", "pos"])
        blocks = blocks.withColumn("members", F.transform("members", lambda m: m.withField("told", F.struct(*told)))) if told else blocks
        own = carried if k == 0 else []
        found = _steps(blocks, own + (["told"] if told else []))
        above = found.select("key", "pos", F.col("steps").alias("above"), *[F.col("told")[c].alias(c) for c in told])
    return found.select("key", "pos", "node", "steps", *own, *[F.col("told")[c].alias(c) for c in told])


def folded(start: Column, steps: str | Column = "steps") -> Column:
    """Root recomputed from a leaf and its steps."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(steps: str | Column = "steps") -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(leaves: DataFrame, id_col: str = "id", by_col: str = "by", leaf_col: str = "leaf") -> DataFrame:
    """All columns of leaves and a struct `merkle` (subroot, root, steps: array of (left, right) siblings from leaf to root).

    A clashing name of the struct is prefixed by `_`.
    """
    out = own_name(leaves.columns, "merkle")
    by = F.col(by_col).cast("string")
    rows = leaves.select(F.when(by.isNull(), F.lit("")).otherwise(F.concat(F.lit("1"), by)).alias("key"), F.col(id_col).alias("id"), F.col(leaf_col).alias("node"),
                         F.monotonically_increasing_id().alias("row"), F.struct("*").alias("own"))
    ranked = ordered_rank(staged(rows, "merkle-leaves"), ["key"], ["id", "node", "row"], "at", "n")
    forest = _climb(ranked.select("key", (F.col("at") - 1).alias("pos"), F.col("n").cast("long").alias("n"), "node", "own"), ["own"])
    subroots = staged(forest[-1].select("key", F.col("top").alias("node")), "merkle-subroots")
    groups = ordered_rank(subroots, [], ["key"], "at", "n").select(F.lit(0).alias("key"), (F.col("at") - 1).alias("pos"), F.col("n").cast("long").alias("n"), "node", F.col("key").alias("group"))
    tree = _climb(groups, ["group"])
    root = tree[-1].select("top").first()
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    above = _descend(tree, tree[-1].select("key", "pos", nothing.alias("above")), ["group"], [])
    above = staged(above.select(F.col("group").alias("key"), F.lit(0).cast("long").alias("pos"), F.col("steps").alias("above"), F.col("node").alias("subroot")), "merkle-groups")
    found = _descend(forest, above, ["own"], ["subroot"])
    told = F.struct("subroot", F.lit(root.top if root else None).cast("string").alias("root"), "steps")
    return found.select(*[F.col("own")[c].alias(c) for c in leaves.columns], told.alias(out))
