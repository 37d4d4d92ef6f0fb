"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

Evidence. A document's statistics fall into few bins. Over all labelled documents one grouped
aggregation counts good and bad per (statistic, bin); a bin also takes `NEAR` to the power of the
distance of each other bin's counts, so that a bin few labels fell into follows its neighbours. The
evidence is the sum of the smoothed log likelihood ratios (a naive Bayes classifier of 60 numbers).

Sites. Labels are counted per host and per path below it. The share of good documents of a host is
shrunk toward the global share, that of a path toward its host, each with a strength estimated from
the counts by the method of moments (beta-binomial intraclass correlation), so sparse sites keep
close to the level above. A labelled document's own labels are taken out of the counts of its path,
host and the whole before its share is formed, so no document judges itself. The posterior log odds of a document are the log odds of its path plus
its evidence; it is rejected below probability one half.

Nulls: a null text counts as empty; null hosts and paths form a site of their own. Rows without
label are scored too. Repeated rows stay; a document with several labels contributes each of them.
Without labels of both kinds all evidence is zero and the global share is one half (kept).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.llm.common import bounded_small, own_name, staged

WORD_GAP = "[\\x20\\x09-\\x0D]+"
#: A word whose next word is the same.
SAME_AGAIN = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?=[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D]))"
BINS = 10
STATISTICS = ("symbols", "marks", "capitals", "digits", "repeats", "distinct")
SMOOTH = 0.5
NEAR = 0.25
FLOOR = 1e-4


def _share(part: Column, whole: Column) -> Column:
    """Bin of a share: the whole part of log2(1 + per mille), at most BINS - 1."""
    return F.least(F.lit(BINS - 1), F.length(F.bin(F.floor(1000 * part / F.greatest(whole, F.lit(1))) + 1)) - 1)


def statistic_bins(text: Column) -> list[Column]:
    """One bin number per statistic of a text, as named columns."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    count = lambda chars: F.regexp_count(t, F.lit(f"[{chars}]"))
    words = F.filter(F.split(t, WORD_GAP), lambda w: w != "")
    again = F.regexp_count(t, F.lit(SAME_AGAIN))
    return [_share(count("#*$%&|<>"), n).alias("symbols"), _share(count("!"), n).alias("marks"), _share(count("A-Z"), n).alias("capitals"), _share(count("0-9"), n).alias("digits"),
            _share(again, F.size(words)).alias("repeats"), _share(F.size(F.array_distinct(words)), F.size(words)).alias("distinct")]


def evidence_table(binned: DataFrame, labels: DataFrame) -> list:
    """[(statistic, bin, share among good, share among bad)]: at most 60 rows, from counts over all labelled documents."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("bin")) for s in STATISTICS]))
    counts = binned.join(labels, "id").select(pairs.alias("p"), "good", "bad").groupBy("p.statistic", "p.bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    rows = counts.collect()
    out = []
    for s in STATISTICS:
        own = [r for r in rows if r.statistic == s]
        if not sum(r.good for r in own) or not sum(r.bad for r in own):
            continue
        near = [[sum(r[c] * NEAR ** abs(r.bin - b) for r in own) + SMOOTH for b in range(BINS)] for c in ("good", "bad")]
        out += [(s, b, near[0][b] / sum(near[0]), near[1][b] / sum(near[1])) for b in range(BINS)]
    return out


def site_counts(binned: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """(host, path, k, n), (host, hk, hn): good and all labels of the sites; the whole's counts and the strengths of both levels."""
    path = staged(binned.join(labels, "id").groupBy("host", "path").agg(F.sum("good").alias("k"), F.sum(F.col("good") + F.col("bad")).alias("n")).filter("n > 0"), "paths")
    host = staged(path.groupBy("host").agg(F.sum("k").alias("hk"), F.sum("n").alias("hn"), F.sum(F.col("n") * F.col("n")).alias("nn")), "hosts")
    g = host.agg(F.sum("hk").alias("k"), F.sum("hn").alias("n"), F.count("*").alias("h")).first()
    if not g.n:
        return path, host.drop("nn"), {"k": 0, "n": 0, "above": 1.0, "below": 1.0}
    mu = (g.k + SMOOTH) / (g.n + 2 * SMOOTH)

    def strength(spread: float, groups: float, effective: float) -> float:
        """Prior strength of a level: (1 - rho) / rho with rho from the weighted spread of shares in units of p(1-p)."""
        rho = (spread - groups) / max(effective - groups, 1.0)
        return 1 / min(max(rho, FLOOR), 1 - FLOOR) - 1

    spread = host.agg(F.sum(F.col("hn") * F.pow(F.col("hk") / F.col("hn") - mu, 2))).first()[0] / (mu * (1 - mu))
    above = strength(spread, g.h, g.n)
    share = (F.col("hk") + above * mu) / (F.col("hn") + above)
    p = path.join(host, "host").agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("hk") / F.col("hn"), 2) / (share * (1 - share))).alias("spread"), F.count("*").alias("paths")).first()
    inside = host.agg(F.sum(F.col("hn") - F.col("nn") / F.col("hn"))).first()[0]
    return path, host.drop("nn"), {"k": g.k, "n": g.n, "above": above, "below": strength(p.spread, p.paths - g.h, inside)}


def site_share(c: dict[str, float], k: Column, n: Column, hk: Column, hn: Column, good: Column, bad: Column) -> Column:
    """Share of a document's path, shrunk to its host, that to the whole, all without the document's own labels."""
    less = lambda x, own: F.greatest(F.coalesce(x, F.lit(0)) - F.coalesce(own, F.lit(0)), F.lit(0))
    whole = (less(F.lit(c["k"]), good) + SMOOTH) / (less(F.lit(c["n"]), good + bad) + 2 * SMOOTH)
    host = (less(hk, good) + c["above"] * whole) / (less(hn, good + bad) + c["above"])
    return (less(k, good) + c["below"] * host) / (less(n, good + bad) + c["below"])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
             quality_col: str = "quality") -> DataFrame:
    """All columns of docs and a struct `quality_model` (evidence, site_share, p_quality, kept); a clashing name is prefixed by `_`."""
    out = own_name(docs.columns, "quality_model")
    host, path = F.coalesce(F.col(host_col).cast("string"), F.lit("")), F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    binned = staged(docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), *statistic_bins(F.col(text_col))), "bins")
    good = labels.filter(F.col(quality_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.sum((F.col(quality_col) > 0).cast("long")).alias("good"), F.sum((F.col(quality_col) <= 0).cast("long")).alias("bad"))
    table = evidence_table(binned, good)
    paths, hosts, whole = site_counts(binned, good)
    paths, hosts, own = bounded_small(paths, "path-counts"), bounded_small(hosts, "host-counts"), bounded_small(good.filter("id is not null"), "own-labels")
    ratio = {s: F.create_map(*([x for st, b, good_p, bad_p in table if st == s for x in (F.lit(int(b)), F.lit(math.log(good_p / bad_p)))] or [F.lit(-1), F.lit(0.0)]))
             for s in STATISTICS}
    keys = {k: own_name(docs.columns, f"__{k}") for k in ("id", "host", "path", "bins", "k", "n", "hk", "hn", "good", "bad")}
    named = lambda df: df.select(*[F.col(c).alias(keys[c]) for c in df.columns])
    kept = docs.withColumns({keys["id"]: F.col(id_col), keys["host"]: host, keys["path"]: path, keys["bins"]: F.struct(*statistic_bins(F.col(text_col)))})
    kept = kept.join(named(own), keys["id"], "left").join(named(paths), [keys["host"], keys["path"]], "left").join(named(hosts), keys["host"], "left")
    evidence = sum((F.coalesce(F.element_at(ratio[s], F.col(keys["bins"])[s]), F.lit(0.0)) for s in STATISTICS), F.lit(0.0))
    site = site_share(whole, *[F.col(keys[c]) for c in ("k", "n", "hk", "hn", "good", "bad")])
    site = F.least(F.greatest(site, F.lit(FLOOR)), F.lit(1 - FLOOR))
    p = 1 / (1 + F.exp(-(F.log(site / (1 - site)) + evidence)))
    return kept.select(*[kept[c] for c in docs.columns], F.struct(evidence.alias("evidence"), site.alias("site_share"), p.alias("p_quality"), (p >= 0.5).alias("kept")).alias(out))


def good_documents(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """Pipeline form: the rows of docs that are kept, with their own columns."""
    scored = classify(docs, labels, **names)
    return scored.filter(F.col(scored.columns[-1])["kept"]).select(*docs.columns)
