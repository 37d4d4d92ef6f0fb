"""SimHash near-duplicates: tiled exact comparison of fingerprints.

A document's fingerprint holds 64 majority bits over the XXH64 values of its word shingles. Two
fingerprints link when they differ in at most `RADIUS` bits; a component is everything reachable.

Exactness and size. Equal fingerprints are one node. The 64 bits are cut into five blocks. Three
differing bits touch at most three blocks, so linked fingerprints agree on two blocks at least and
meet under one of ten block-pair keys: a *bucket*. A bucket is compared in tiles, by exclusive-or and
bit counts in numpy. Tiles are runs of population counts; a pair of tiles whose population counts
differ by more than the radius is never built, because the Hamming distance is at least that
difference. A bucket of any size becomes many bounded tile pairs, so none lands in one task.
A tile pair returns a spanning forest of its links, which keeps every connection and is linear.

Nulls and empty texts have no words and fingerprint zero, which links like any other. Rows with a
null or repeated id keep their own row; the component id is the smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.common import bounded_small, own_name, sliced, staged

RADIUS = 3
#: Fingerprints in one tile at most.
TILE = 4096
#: Widths of the five blocks; any two hold 25 or 26 bits.
BLOCKS = (13, 13, 13, 13, 12)
CHUNK = 1 << 15


def shingle_hashes(text: str | None, width: int = 3) -> list[int]:
    """XXH64 of every word shingle of one text; one of all words where they are fewer, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) < width:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)]


def text_fingerprint(text: str | None, width: int = 3) -> int:
    """64 majority bits over the shingles of one text; 0 without words."""
    return majority_bits(shingle_hashes(text, width))


def majority_bits(hashes) -> int:
    """Bits that are set in over half of the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.array(hashes[i:i + CHUNK], dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long; rows are neither dropped nor merged."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(parts):
            fps = np.fromiter((text_fingerprint(t, width) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def block_keys(fp: str = "fp"):
    """Ten keys, one for each pair of blocks: the pair's number above the bits of its blocks."""
    cuts, at = [], 0
    for w in BLOCKS:
        cuts.append(F.shiftrightunsigned(F.col(fp), at).bitwiseAND((1 << w) - 1))
        at += w
    pairs = [(i, j) for i in range(len(BLOCKS)) for j in range(i)]
    return F.array(*[F.lit(k << 26).bitwiseOR(F.shiftleft(cuts[i], 13)).bitwiseOR(cuts[j]) for k, (i, j) in enumerate(pairs)])


def tile_forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within one set of distinct fingerprints, each tree as a star on its first node."""
    n = len(fps)
    v = fps[np.argsort(np.bitwise_count(fps), kind="stable")]
    root = np.arange(n)
    pc = np.bitwise_count(v).astype(np.int16)
    last = np.searchsorted(pc, pc + radius, side="right")
    step = max(1, (1 << 22) // max(n, 1))
    for a in range(0, n, step):
        b = min(n, a + step)
        near = np.bitwise_count(v[a:b, None] ^ v[None, a:last[b - 1]]) <= radius
        for i in range(a, b):
            # Labels of the nodes in reach; merging relabels whole trees, at most n - 1 times in all.
            met = root[i:last[i]][near[i - a, i - a:last[i] - a]]
            low = met.min()
            if met.max() != low:
                for x in np.unique(met)[1:]:
                    root[root == x] = low
    off = root != np.arange(n)
    return v[off], v[root[off]]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): forests of the links between the distinct fingerprints of `nodes` (column fp)."""
    if radius > 3:
        raise ValueError("the block keys are exact up to three differing bits")
    keyed = nodes.select("fp", F.bit_count("fp").alias("pc"), F.explode(block_keys()).alias("key"))
    # Population counts of each bucket: at most 65 numbers a bucket, combined on the map side.
    hist = (keyed.groupBy("key", "pc").agg(F.count("*").alias("n")).groupBy("key")
            .agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("pc", "n"))).alias("hist")).filter("total > 1"))
    # Runs of population counts with at most `tile` fingerprints; a count with more is sliced by hash. (lo, hi, slices)
    add = (f"case when size(t) > 0 and element_at(t, -1).n + h.n <= {tile} "
           "then concat(slice(t, 1, size(t) - 1), array(named_struct('lo', element_at(t, -1).lo, 'hi', h.pc, 'n', element_at(t, -1).n + h.n))) "
           "else concat(t, array(named_struct('lo', h.pc, 'hi', h.pc, 'n', h.n))) end")
    tiled = hist.select("key", F.expr(f"aggregate(hist, cast(array() as array<struct<lo:int,hi:int,n:bigint>>), (t, h) -> {add})").alias("tiles"))
    tiled = tiled.select("key", F.expr(f"transform(tiles, t -> named_struct('lo', t.lo, 'hi', t.hi, 's', cast(ceil(t.n / {tile}) as int)))").alias("tiles"))
    rows = keyed.join(tiled, "key")
    # A row's own tile and slice, then every tile pair it takes part in: only tiles within the radius.
    rows = rows.select("key", "fp", "pc", "tiles", F.expr("filter(sequence(0, size(tiles) - 1), i -> pc between tiles[i].lo and tiles[i].hi)[0]").alias("own"))
    rows = rows.withColumn("part", F.expr("cast(pmod(xxhash64(fp), tiles[own].s) as int)"))
    near = (f"filter(sequence(0, size(tiles) - 1), i -> tiles[i].lo <= tiles[own].hi + {radius} and tiles[i].hi >= tiles[own].lo - {radius})")
    me, other = "own * 1000000L + part", "i * 1000000L + s"
    pair = f"named_struct('x', least({me}, {other}), 'y', greatest({me}, {other}))"
    alone = "size(tiles) = 1 and tiles[0].s = 1"
    whole = "array(named_struct('x', 0L, 'y', 0L))"
    # A pair (x, x) is compared within every pair that holds x, so it is built only where a tile has no neighbour.
    mates = f"filter(flatten(transform({near}, i -> transform(sequence(0, tiles[i].s - 1), s -> {pair}))), p -> p.x <> p.y)"
    rows = rows.withColumn("pairs", F.expr(f"case when {alone} then {whole} when size({mates}) = 0 then array(named_struct('x', {me}, 'y', {me})) else {mates} end"))
    groups = rows.select("key", "fp", F.explode("pairs").alias("p")).groupBy("key", "p").agg(F.collect_list("fp").alias("fps"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(parts):
            a, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            col = b.column(0)
            flat, cuts = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                x, y = tile_forest(flat[i:j].view(np.uint64), radius)
                a.append(x.view(np.int64))
                c.append(y.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], names=["a", "b"])

    return groups.select("fps").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star steps on a written edge table until nothing changes; each
    step keeps connectivity, the number of edges never grows, and rounds grow with the logarithm.
    """
    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        return e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b")

    def settle(e: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        e = staged(e.distinct(), name)
        return e, tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    cur, seen = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"), "edges")
    while True:
        cur, now = settle(small(large(cur)), "edges")
        if now == seen:
            break
        seen = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("label")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id of the row's component."""
    fps = staged(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = staged(fps.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    labels = components(staged(links(nodes, radius, tile), "links"))
    labelled = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = labelled.join(firsts, "label").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    """16 lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near=near_duplicates, **options) -> DataFrame:
    """Pipeline form: of each component of `near` one row, that with the smallest id (nulls last), with its own columns.

    Rows are numbered and written first, so that repeated and null ids are told apart.
    """
    key = own_name(docs.columns, "__row")
    stamped = staged(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = near(stamped, key, text_col, **options).select(F.col("id").alias(key), F.col("component_id").alias("__component"))
    ids = stamped.select(key, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(key).alias("row")).alias("rank"))
    ranked = found.join(ids, key)
    best = ranked.groupBy("__component").agg(F.min("rank").alias("best"), F.count("*").alias("rows")).filter("rows > 1")
    # Only the rows that go meet the texts again: few, and broadcast while they are.
    gone = bounded_small(ranked.join(best, "__component").filter(F.col("rank.row") != F.col("best.row")).select(key), "gone", 32)
    return stamped.join(gone, key, "left_anti").select(*docs.columns)
