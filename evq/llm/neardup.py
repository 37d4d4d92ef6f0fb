"""Near-duplicates by exact Jaccard similarity of word shingles, SimHash first.

Two texts link when the sets of their five-word shingles have a Jaccard similarity of at least 4/5;
a component is everything reachable. Texts of the same set are one node. No pair is missed.

SimHash. The 64 majority bits of a node's shingles are compared in tiles (`simhash.links`); what lies within
three bits is confirmed on the whole sets. This joins the closest copies, however many, at the cost of
fingerprints. Similarity 0.8 may differ in more bits, so the rest goes through a prefix filter.

Prefix filter. Under any one order of all shingles, two sets that link share a shingle among the first
n - ceil(4n/5) + 1 of each (n: shingles of the set). The order is by hash, except that shingles counted
often come last, by rising count, so that common lines bring few texts together. One counting pass, in
which hashes travel packed in four bytes, yields these and a bitmap of fixed size of the shingles met twice;
a shingle that was counted once joins nothing and is not shuffled again. Counts and bitmap affect the speed only.

Confirmation. Each node keeps how many of its shingles fall into each of 256 buckets; the sum of the smaller counts
of two nodes bounds what they share, so pairs below the limit are dropped before whole sets meet. The odd buckets, as
256 bits, bound it more loosely but cheaply: buckets odd in one node alone are no more than the shingles that the two do not share.

Hot groups. A shingle whose nodes lie in one component already is dropped by its smallest and largest label.
First every node proposes the node with which it shares most of the ends of its shingles, one pair for each
node. Then all pairs that still lie in different components are compared, in a join that may be split and that
makes a pair only if its odd buckets allow the similarity, and not again where one of the BEFORE shingles before
this one is shared as well: texts that share a long passage meet once for each run of it, not at each shingle.

Nulls and texts without words have the empty set and are one node; a text of fewer than five words is one
shingle. Rows with a null or repeated id keep their own row (`first_of_each`). Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evq.functions.lineage import discard
from evq.llm import simhash
from evq.llm.common import bounded_small, own_name, sliced, staged
from evq.llm.simhash import components, majority_bits, shingle_hashes

WIDTH = 5
#: Least Jaccard similarity, as a fraction of integers.
OVER, UNDER = 4, 5
#: Shingles in more texts than this come last in the order, at most so many of them.
COMMON, MOST_COMMON = 50, 1 << 17
#: Buckets of a node's counts.
BUCKETS = 256
#: Columns of 64 bits that tell which buckets are odd.
ODD = [f"odd{k}" for k in range(BUCKETS // 64)]
#: Bits of the bitmap's size: 2**27 bits or 16 MB, whatever the corpus.
MAP_BITS = 27
#: Shingles before an entry, in its node's order, by which a pair that was met before is known.
BEFORE = 4
#: Hashes that a task packs before it sends them on, and hashes of one group of the counting pass.
PACK, GROUP = 1 << 21, 1 << 20


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text."""
    return np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))


def prefix_length(n: int) -> int:
    return n - -(-OVER * n // UNDER) + 1 if n else 0


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 42)


def _signed(values, kind=np.uint64) -> pa.Array:
    return pa.array(np.asarray(values, dtype=kind).view(np.int64))


def bucket_counts(s: np.ndarray) -> bytes:
    """Shingles in each bucket, two bytes each; the largest value stands for any number from there on."""
    return np.minimum(np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 65535).astype(np.uint16).tobytes()


def odd_buckets(s: np.ndarray) -> np.ndarray:
    """Which buckets hold an odd number of the shingles, in len(ODD) words of 64 bits."""
    return np.packbits(np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.uint8) & 1).view(np.int64)


def nodes_of(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, node, n, fp, counts, odd0, ...) of every row: the set's digest, size, majority bits, bucket counts and odd buckets."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(parts):
            sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
            odd = np.array([odd_buckets(s) for s in sets], dtype=np.int64).reshape(-1, len(ODD))
            yield pa.RecordBatch.from_arrays([b.column(0), _signed([_node(s) for s in sets]), pa.array([len(s) for s in sets], type=pa.int32()), _signed([majority_bits(s) for s in sets]),
                                              pa.array([bucket_counts(s) for s in sets], type=pa.binary()), *[pa.array(odd[:, k]) for k in range(len(ODD))]], names=["id", "node", "n", "fp", "counts", *ODD])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, node long, n int, fp long, counts binary, {', '.join(f'{c} long' for c in ODD)}")


def group_bits(shingles: int) -> int:
    """Leading bits of a hash that name its group in the counting pass."""
    return min(max(6, (max(shingles, 1) // GROUP).bit_length()), 20)


def counted_shingles(docs: DataFrame, text_col: str, width: int, common: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(common shingles by rising count, bitmap of those met twice), from the front of every text's order by hash.

    A shingle is told by the first bits + 32 of its hash, the bitmap by its first MAP_BITS.
    """
    shift = np.uint64(32 - bits)

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            rows = []
            group = (h >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(h) else np.empty(0, np.int64)
            for i, j in zip(cuts, [*cuts[1:], len(h)]):
                low, many = h[i:j].astype(np.uint32), n[i:j] > 1
                rows.append((int(group[i]), low[~many].tobytes(), low[many].tobytes(), n[i:j][many].astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(list(x), type=k) for x, k in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["g", "one", "more", "counts"])

        held, size = [], 0
        for b in sliced(parts):
            for t in b.column(0).to_pylist():
                s = shingle_set(t, width)
                held.append(s[:prefix_length(len(s)) + len(s) // 8 + 2] >> shift)
                size += len(held[-1])
            if size >= PACK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def count(group: pa.Table) -> pa.Table:
        g = group.column("g")[0].as_py()
        join = lambda c: np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=np.uint32)
        one, more, n = join("one"), join("more"), join("counts")
        low, where = np.unique(np.concatenate((one, more)), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate((np.ones(len(one)), n))).astype(np.int64)
        bitmap = np.zeros(1 << (MAP_BITS - bits), dtype=bool)
        bitmap[low[total > 1] >> np.uint32(32 - MAP_BITS + bits)] = True
        often = np.flatnonzero(total > common)
        often = often[np.argsort(-total[often], kind="stable")[:MOST_COMMON]]
        key = (np.uint64(g) << np.uint64(32)) | low[often].astype(np.uint64)
        return pa.table({"g": pa.array([g], type=pa.int32()), "bitmap": pa.array([np.packbits(bitmap).tobytes()], type=pa.binary()),
                         "often": pa.array([key.view(np.int64)], type=pa.list_(pa.int64())), "n": pa.array([total[often]], type=pa.list_(pa.int64()))})

    packed = docs.select(F.col(text_col).alias("text")).mapInArrow(pack, "g int, one binary, more binary, counts binary")
    counts = staged(packed.groupBy("g").applyInArrow(count, "g int, bitmap binary, often array<long>, n array<long>"), "shingle-counts")
    bitmap = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    size = len(bitmap) >> bits
    for r in counts.select("g", "bitmap").toLocalIterator():
        bitmap[r.g * size:(r.g + 1) * size] = np.frombuffer(r.bitmap, dtype=np.uint8)
    top = counts.select(F.explode(F.arrays_zip("often", "n")).alias("x")).select("x.*").orderBy(F.desc("n"), "often").limit(MOST_COMMON).collect()
    discard(counts)
    return np.array([r.often for r in reversed(top)], dtype=np.int64).view(np.uint64), bitmap


def prefix_entries(docs: DataFrame, text_col: str, width: int, last: np.ndarray, bitmap: np.ndarray, bits: int) -> DataFrame:
    """(shingle, node, n, at): the prefix of every text less the shingles counted once; at is the position in the order."""
    held = docs.sparkSession.sparkContext.broadcast((np.sort(last), np.argsort(last, kind="stable"), bitmap))
    shift = np.uint64(32 - bits)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, twice = held.value
        for b in sliced(parts):
            out: list[list[np.ndarray]] = [[np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]]
            for t in b.column(0).to_pylist():
                s = shingle_set(t, width)
                n, p = len(s), prefix_length(len(s))
                counted = np.arange(n) < p + n // 8 + 2
                if len(known):
                    i = np.minimum(np.searchsorted(known, s >> shift), len(known) - 1)
                    late = known[i] == s >> shift
                    if late.any():
                        order = np.concatenate((np.flatnonzero(~late), np.flatnonzero(late)[np.argsort(rank[i[late]], kind="stable")]))
                        s, counted = s[order], counted[order]
                place = s[:p] >> np.uint64(64 - MAP_BITS)
                met = (twice[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1
                keep = np.flatnonzero((met > 0) | ~counted[:p])
                for o, x in zip(out, (s[keep], np.full(len(keep), _node(np.sort(s)), np.uint64), np.full(len(keep), n, np.int32), keep.astype(np.int32)), strict=True):
                    o.append(x)
            a, c, d, e = (np.concatenate(o) for o in out)
            yield pa.RecordBatch.from_arrays([_signed(a), _signed(c), pa.array(d), pa.array(e)], names=["shingle", "node", "n", "at"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "shingle long, node long, n int, at int")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose bucket counts leave room for the similarity. nodes: (node, counts, ...)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(parts, 8192):
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS) for c in (2, 3))
            low = np.minimum(x, y)
            fits = (OVER + UNDER) * low.sum(axis=1, dtype=np.int64) >= OVER * (x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64))
            keep = pa.array(fits | (x == 65535).any(axis=1) | (y == 65535).any(axis=1))
            yield b.select(["a", "b"]).filter(keep)

    counts = lambda c: nodes.select(F.col("node").alias(c), F.col("counts").alias(f"{c}_counts"))
    return pairs.join(counts("a"), "a").join(counts("b"), "b").select("a", "b", "a_counts", "b_counts").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes that have the similarity. firsts: (node, id) of one row of each node."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(parts):
            sets = [shingle_set(t, width).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, type=pa.list_(pa.int64()))], names=["node", "s"])

    pairs = staged(possible(pairs, firsts), "possible-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    rows = bounded_small(firsts.join(wanted, "node", "left_semi").select("node", F.col("id").alias("__id")), "candidates", 32)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(rows, "__id").select("node", "text")
    sets = staged(texts.mapInArrow(run, "node long, s array<long>"), "shingle-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("k"))
    found = staged(both.filter(F.col("k") * UNDER >= (F.col("n") - F.col("k")) * OVER).select("a", "b"), "links")
    discard(sets)
    discard(pairs)
    return found


def _fits(n, m):
    return F.least(n, m) * UNDER >= F.greatest(n, m) * OVER


def _mixed(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with the label of their node, of those shingles that are met in two components, with the smallest and the largest node."""
    one = F.struct("node", "n")
    named = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ends = named.groupBy("shingle").agg(F.min("label").alias("few"), F.max("label").alias("many"), F.min(one).alias("low"), F.max(one).alias("high")).filter("few <> many")
    return named.join(ends.drop("few", "many"), "shingle")


def with_before(entries: DataFrame) -> DataFrame:
    """Entries with `before`: up to BEFORE shingles that precede each in its node's order."""
    return entries.withColumn("before", F.collect_list("shingle").over(Window.partitionBy("node").orderBy("at").rowsBetween(-BEFORE, -1)))


def met_pairs(apart: DataFrame) -> DataFrame:
    """(a, b), some more than once: nodes of different labels that share a shingle and may have the similarity.

    All nodes have one order, so the first shingle that two nodes share has no shared one before it in either, and
    the bound by position is loosest there: a pair left out at a later shingle was made at an earlier one.
    """
    x, y = (apart.select("shingle", *[F.col(c).alias(f"{c}{k}") for c in ("node", "n", "at", "label", "before", *ODD)]) for k in (1, 2))
    # Where the shingle is the first that both share, no more than what follows it on either side can be shared.
    most = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
    # Sets of the similarity differ in at most (UNDER - OVER) / (OVER + UNDER) of the shingles of both.
    differ = sum(F.bit_count(F.col(f"{c}1").bitwiseXOR(F.col(f"{c}2"))) for c in ODD)
    fits = _fits(F.col("n1"), F.col("n2")) & (most * (OVER + UNDER) >= (F.col("n1") + F.col("n2")) * OVER) & (differ * (OVER + UNDER) <= (F.col("n1") + F.col("n2")) * (UNDER - OVER))
    met = x.join(y, "shingle").filter((F.col("node1") < F.col("node2")) & (F.col("label1") != F.col("label2")) & fits & ~F.arrays_overlap("before1", "before2"))
    return met.select(F.col("node1").alias("a"), F.col("node2").alias("b"))


def links(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, common: int = COMMON) -> DataFrame:
    """(a, b): pairs of nodes with the similarity, enough of them to connect every component.

    nodes: (node, id, n, fp, counts, odd0, ...), one row of docs for each node; docs holds these rows alone.
    """
    close = simhash.links(nodes.filter("n > 0").select("fp").distinct())
    first = nodes.filter("n > 0").groupBy("fp").agg(F.min("node").alias("node"))
    near = close.join(first.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select("x", "y")
    same = nodes.filter("n > 0").join(first.withColumnRenamed("node", "x"), "fp").select("x", F.col("node").alias("y"))
    tried = staged(near.union(same).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "simhash-pairs")
    found = confirmed(tried, docs, nodes, id_col, text_col, width)

    bits = group_bits((nodes.agg(F.sum("n")).first()[0] or 0) // 3)
    last, bitmap = counted_shingles(docs, text_col, width, common, bits)
    entries = staged(prefix_entries(docs, text_col, width, last, bitmap, bits), "prefixes")
    mixed = staged(_mixed(entries, components(found)), "mixed")
    discard(entries)
    # Each node proposes the end with which it shares most shingles.
    ends = [mixed.filter((F.col("node") != F.col(f"{c}.node")) & _fits(F.col("n"), F.col(f"{c}.n"))).select("node", F.col(f"{c}.node").alias("end")) for c in ("low", "high")]
    best = ends[0].union(ends[1]).groupBy("node", "end").count().groupBy("node").agg(F.max(F.struct("count", "end")).alias("x"))
    proposed = staged(best.select(F.least("node", "x.end").alias("a"), F.greatest("node", "x.end").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "proposals")
    found, tried = staged(found.union(confirmed(proposed, docs, nodes, id_col, text_col, width)), "links"), staged(tried.union(proposed), "tried")
    marked = nodes.filter("n > 0").select("node", *ODD).join(components(found), "node", "left")
    apart = staged(with_before(_mixed(mixed.select("shingle", "node", "n", "at"), marked).drop("low", "high")), "apart")
    discard(mixed)
    rest = staged(met_pairs(apart).distinct().join(tried, ["a", "b"], "left_anti"), "rest-pairs")
    discard(apart)
    return found.union(confirmed(rest, docs, nodes, id_col, text_col, width))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, common: int = COMMON) -> DataFrame:
    """(id, component_id) for every row of docs, whose ids differ; component_id is the smallest id of the row's component."""
    rows = staged(nodes_of(docs, id_col, text_col, width), "shingle-nodes")
    nodes = staged(rows.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("counts").alias("counts"), *[F.first(c).alias(c) for c in ODD]), "shingle-firsts")
    copies = bounded_small(rows.join(nodes.select("id"), "id", "left_anti").select(F.col("id").alias(id_col)), "copies", 32)
    labels = components(links(docs.join(copies, id_col, "left_anti"), nodes, id_col, text_col, width, common))
    labelled = nodes.join(labels, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("id").alias("component_id"))
    return rows.select("id", "node").join(labelled.join(smallest, "label").select("node", "component_id"), "node").select("id", "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row, that with the smallest id, with its own columns.

    Where ids are null or repeated, rows are numbered and written first (`simhash.first_of_each`), nulls coming last.
    """
    if not docs.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty():
        return simhash.first_of_each(docs, id_col, text_col, near=near_duplicates)
    found = near_duplicates(docs, id_col, text_col)
    key = own_name(docs.columns, "__gone")
    gone = bounded_small(found.filter("id <> component_id").select(F.col("id").alias(key)), "gone", 32)
    return docs.join(gone, F.col(id_col) == F.col(key), "left_anti")
