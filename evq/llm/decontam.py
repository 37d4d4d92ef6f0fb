"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are all windows of 13 consecutive words of the benchmark items (a shorter item is one
window). Windows of one length form a pattern set with a shift table over blocks of two words: the
search looks at the block that ends at a position, skips as far as no window can end, and where the
shift is zero takes the bucket of windows with that suffix block and compares them word by word.
A document is read whole, word by word, in one task; documents are independent, so no shuffle is needed.

The benchmark is collected in blocks of at most BLOCK_BYTES of text, one search pass per block, so
what a task holds is bounded however large the benchmark grows.

Null or empty texts have no words and no hits. Rows keep their number and ids; items with a null id
mark words but are not listed; items sharing an id count once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evq.llm.common import own_name

WINDOW = 13
BLOCK_BYTES = 16 << 20
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, a-z and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Patterns:
    """Shift tables and suffix buckets for one block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.ids: dict[bytes, int] = {}
        owners: dict[int, dict[tuple[int, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids)) for x in words_of(text)]
            if w:
                m = min(window, len(w))
                for i in range(len(w) - m + 1):
                    owners[m][tuple(w[i:i + m])].add(item)
        self.base = len(self.ids) + 1
        self.sets = [self._tables(m, found) for m, found in sorted(owners.items())]

    def _tables(self, m: int, found: dict[tuple[int, ...], set]):
        b = min(2, m)
        shift: dict[int, int] = {}
        bucket: dict[int, list] = defaultdict(list)
        for w, items in found.items():
            for end in range(b - 1, m):
                block = w[end] if b == 1 else w[end - 1] * self.base + w[end]
                shift[block] = min(shift.get(block, m), m - 1 - end)
            bucket[block].append((list(w), items))
        return m, b, shift, dict(bucket)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged (start, end) word ranges that some window covers, and the items found."""
        get = self.ids.get
        ids, n, base = [get(w, -1) for w in words], len(words), self.base
        ranges, items = [], set()
        for m, b, shift, bucket in self.sets:
            i, skip = m - 1, m - b + 1
            while i < n:
                if ids[i] < 0:
                    i += m
                    continue
                block = ids[i] if b == 1 else ids[i - 1] * base + ids[i] if ids[i - 1] >= 0 else -1
                s = shift.get(block, skip)
                if s:
                    i += s
                    continue
                here = ids[i - m + 1:i + 1]
                for w, owners in bucket.get(block, ()):
                    if w == here:
                        ranges.append((i - m + 1, i + 1))
                        items |= owners
                i += 1
        return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """(id, n_words, n_hit, spans, items, contaminated) per row; with `keep`, the columns of docs instead, of clean rows only."""
    spark = docs.sparkSession
    texts = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    blocks = int((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) + 1
    shape = "struct<spans: array<struct<a: int, b: int>>, items: array<string>>"
    hits, col = own_name(docs.columns, "__hits"), F.col(text_col)
    found = docs.withColumn(hits, F.lit(None).cast(shape))
    kind = found.schema[hits].dataType

    def searcher(patterns):
        # Only the texts and earlier hits go to Python; the rows wait on the other side.
        @F.arrow_udf(kind)
        def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            p = patterns.value
            for texts, before in parts:
                out = []
                for text, old in zip(texts, before, strict=True):
                    (ranges, new), old = p.search(words_of(text.as_py())), old.as_py() or {"spans": [], "items": []}
                    ranges = merged([(r["a"], r["b"]) for r in old["spans"]] + ranges) if old["spans"] else ranges
                    out.append({"spans": [{"a": x, "b": y} for x, y in ranges], "items": sorted(set(old["items"]) | {x for x in new if x is not None})})
                yield pa.array(out, type=before.type)

        return run

    for k in range(blocks):
        part = texts.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        found = found.withColumn(hits, searcher(spark.sparkContext.broadcast(Patterns([(r.item, r.text) for r in part], window)))(col, F.col(hits)))
    # Runs of the same characters before lower-casing: A-Z belong to words.
    n_words = F.regexp_count(F.coalesce(col, F.lit("")), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long")
    n_hit = F.aggregate(F.col(hits)["spans"], F.lit(0).cast("long"), lambda t, s: t + s["b"] - s["a"])
    bad = (n_hit > 0) & (share * n_hit >= n_words)
    if keep:
        return found.filter(~bad).drop(hits)
    return found.select(F.col(id_col).alias("id"), n_words.alias("n_words"), n_hit.alias("n_hit"), F.col(hits)["spans"].alias("spans"), F.col(hits)["items"].alias("items"), bad.alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """Pipeline form: rows that are not contaminated, with their own columns."""
    return contamination(docs, benchmark, keep=True, **names)
