"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four patterns, with their validity rules.
Offsets come from the pieces between the matches, so a text is scanned once per kind and never
exploded. The patterns use possessive repeats and one look-behind; they find the same matches as the
plain forms without quadratic scans or deep recursion on very long runs.

Sanitisation. A protected entity is a distinct base value (an address, number or card). Its contexts
are the lines that hold it. A term discloses an entity when it occurs in at least MIN_CONTEXTS
different contexts of it, at least LEAST_SHARE of its occurrences in the whole corpus are in lines of that
entity, and its pointwise mutual information with the entity is at least MIN_BITS. Different contexts
are counted over distinct lines, so copies of one document don't make their words look revealing.
Disclosing terms become further spans (kind `term`) in the lines of that entity. `sanitise`
generalises base spans to their kind and removes terms.

Nulls and empty texts have no spans. Repeated rows are treated alike. No row is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.llm.common import bounded_small, own_name, staged

#: Match-equivalent, stack-safe forms of the contract's patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
WORD_GAP = r"[\x20\x09-\x0D]+"
MIN_CONTEXTS, LEAST_SHARE, MIN_BITS = 3, 0.5, 8.0


SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
BLOCK = 128


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once, as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an int array, block by block, so that long arrays aren't copied once per element."""
    def scan(x: Column, inclusive: bool) -> Column:
        grow = lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"] + v if inclusive else s["at"])).alias("out"))
        return F.aggregate(x, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), grow, lambda s: s["out"])

    def whole(x: Column) -> Column:
        count = F.floor((F.size(x) - 1) / BLOCK).cast("int")
        local = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda b: scan(F.slice(x, b * BLOCK + 1, BLOCK), True))
        last = lambda y: F.coalesce(F.get(y, F.size(y) - 1), F.lit(0))
        return _bound(local, lambda ls: F.flatten(F.zip_with(ls, scan(F.transform(ls, last), False), lambda y, o: F.transform(y, lambda v: v + o))))

    return _bound(values, whole)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum over the digits from the right, every second one doubled, is a multiple of ten."""
    ds = F.split(F.reverse(digits), "")
    doubled = F.transform(F.filter(ds, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        # Where a part has too many digits for an int, the cast fails.
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def kind_spans(kind: str, text: Column) -> Column:
    """Array of (kind, start, end, value) of the valid matches of one kind; offsets in code points."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0)
    # A match ends after all gaps and matches up to it; the gap behind the last match has no partner.
    ends = running_sums(F.zip_with(found, F.transform(F.split(text, PATTERNS[kind], -1), F.length), lambda m, g: F.coalesce(F.length(m), F.lit(0)) + g))
    spans = F.zip_with(found, ends, lambda m, e: F.when(m.isNotNull(), F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"))))
    return F.when(text.rlike(PATTERNS[kind]), F.filter(spans, lambda x: x.isNotNull() & _valid(kind, x["value"]))).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.flatten(F.array(*[kind_spans(k, t) for k in KINDS]))


def entity(kind: Column, value: Column) -> Column:
    """What identifies an entity: its digits for numbers, the folded text otherwise."""
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _lines(text: Column) -> Column:
    """Array of (start, line) of the lines of a text; starts in code points. No base pattern reaches over a line end."""
    return _bound(F.split(text, "\n", -1), lambda ls: F.zip_with(ls, running_sums(F.transform(ls, lambda x: F.length(x) + 1)), lambda x, e: F.struct((e - F.length(x) - 1).alias("start"), x.alias("line"))))


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")


def disclosing_terms(spotted: DataFrame, texts: DataFrame, min_contexts: int = MIN_CONTEXTS, least_share: float = LEAST_SHARE, min_bits: float = MIN_BITS) -> DataFrame:
    """(entity, term) above the disclosure thresholds.

    spotted: (row, text, base) of the rows with base spans; texts: (text) of all rows.
    """
    lines = spotted.select(F.explode(F.split("text", "\n", -1)).alias("line")).withColumn("own", base_spans(F.col("line"))).filter(F.size("own") > 0)
    held = staged(lines.select(F.explode(F.array_distinct(F.transform("own", lambda s: entity(s["kind"], s["value"])))).alias("entity"), "line",
                               F.xxhash64("line").alias("context")), "entity-lines")
    # A copied line counts once as a context and each time as an occurrence.
    contexts = held.groupBy("entity", "context").agg(F.first("line").alias("line"), F.count("*").alias("times"))
    several = contexts.groupBy("entity").agg(F.count("*").alias("different"), F.sum("times").alias("entity_lines")).filter(F.col("different") >= min_contexts)
    near = (contexts.join(several, "entity").select("entity", "entity_lines", "times", F.explode(F.array_distinct(_terms(F.col("line")))).alias("term"))
            .groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("times").alias("both"), F.first("entity_lines").alias("entity_lines")).filter(F.col("contexts") >= min_contexts))
    near = staged(near, "candidates")
    wanted = bounded_small(near.select("term").distinct(), "candidate-terms")
    all_lines = texts.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    held_lines = texts.select(F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(1)).alias("n")).first().n
    freq = all_lines.select(F.explode(F.array_distinct(_terms(F.col("line")))).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("lines"))
    scored = near.join(freq, "term").withColumn("bits", F.log2(F.col("both") * F.lit(float(held_lines)) / (F.col("lines") * F.col("entity_lines"))))
    return scored.filter((F.col("both") / F.col("lines") >= least_share) & (F.col("bits") >= min_bits)).select("entity", "term", "bits")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """All columns of docs and an array `pii` of (kind, start, end, value): base spans by kind, then disclosing terms."""
    out = own_name(docs.columns, "pii")
    key = own_name(docs.columns, "__base")
    marked = docs.withColumn(key, base_spans(F.col(text_col)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    spotted = staged(marked.filter(F.size(key) > 0).select(text.alias("text"), F.col(key).alias("base")), "spotted")
    terms = disclosing_terms(spotted, docs.select(F.col(text_col).alias("text")), **thresholds)
    by_entity = bounded_small(terms.groupBy("entity").agg(F.collect_set("term").alias("terms")), "disclosing", 4096)
    # Spans of terms: per distinct (text, base), only where an entity has disclosing terms.
    lines = (spotted.select("text").distinct().select(F.sha2("text", 256).alias("text"), F.explode(_lines(F.col("text"))).alias("l"))
             .withColumn("own", base_spans(F.col("l.line"))).filter(F.size("own") > 0))
    hits = (lines.select("text", "l", "own", F.explode(F.array_distinct(F.transform("own", lambda s: entity(s["kind"], s["value"])))).alias("entity")).join(by_entity, "entity")
            .groupBy("text", "l", "own").agg(F.flatten(F.collect_list("terms")).alias("terms")))
    words = hits.withColumn("words", _word_spans(F.col("l.line")))
    keep = F.filter("words", lambda w: F.array_contains(F.col("terms"), F.lower(w["value"])) & ~F.exists("own", lambda s: (s["start"] < w["end"]) & (s["end"] > w["start"])))
    moved = F.transform(keep, lambda w: F.struct(w["kind"].alias("kind"), (w["start"] + F.col("l.start")).alias("start"), (w["end"] + F.col("l.start")).alias("end"), w["value"].alias("value")))
    more = words.select("text", moved.alias("more")).groupBy("text").agg(F.sort_array(F.flatten(F.collect_list("more"))).alias("more"))
    more = bounded_small(more.filter(F.size("more") > 0).select(F.col("text").alias("__sha"), "more"), "term-spans", 4096)
    sha, extra = own_name(docs.columns, "__sha"), own_name(docs.columns, "__more")
    more = more.withColumnRenamed("__sha", sha).withColumnRenamed("more", extra)
    joined = marked.withColumn(sha, F.when(F.size(key) > 0, F.sha2(text, 256))).join(more, sha, "left")
    spans = F.concat(F.col(key), F.coalesce(F.col(extra), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")))
    return joined.select(*[marked[c] for c in docs.columns], spans.alias(out))


def _word_spans(line: Column) -> Column:
    """Array of (kind 'term', start, end, value) of the words of a line."""
    words = F.filter(F.split(line, WORD_GAP), lambda w: w != "")
    ends = running_sums(F.zip_with(words, F.transform(F.split(line, r"[^\x20\x09-\x0D]+", -1), F.length), lambda m, g: F.coalesce(F.length(m), F.lit(0)) + g))
    spans = F.zip_with(words, ends, lambda m, e: F.when(m.isNotNull(), F.struct(F.lit("term").alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"))))
    return F.filter(spans, lambda x: x.isNotNull())


def sanitised(text: Column, spans: Column) -> Column:
    """Text with base spans generalised to `[kind]` and terms removed; where spans overlap, the earlier and longer one wins."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(x["end"].alias("at"), F.concat(
        s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.when(x["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), x["kind"], F.lit("]")))).alias("out")))
    done = F.aggregate(order, state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitised_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """Pipeline form: every row stays; personal data in the text is generalised or removed."""
    found = find(docs, id_col, text_col, **thresholds)
    return found.withColumn(text_col, sanitised(F.col(text_col), F.col(found.columns[-1]))).select(*docs.columns)
