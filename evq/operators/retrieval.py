"""Firewalled retrieval: as-of BM25, TF-IDF, exact vector search, fusion, evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.functions.lineage import cut, stage
from evq.functions.sizing import small, spread
from evq.functions.windows import asof_join, past_totals
from evq.operators.asof import visible_from

TOKEN = r"([\x{4e00}-\x{9fff}]|[a-z0-9]+)"
# fixed values: stop words
STOP = ("的", "了", "在", "是", "和", "与", "对", "为", "将", "等", "也", "都", "但", "及")


def tokens(text: Column, min_len: int = 2) -> Column:
    """Lower-case alphanumeric tokens of at least min_len characters, without stop words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    if min_len > 1:  # only alphanumeric runs can be that long, so the pattern does the filtering
        return F.regexp_extract_all(low, F.lit(r"([a-z0-9]{%d,})" % min_len), F.lit(1))
    found = F.regexp_extract_all(low, F.lit(TOKEN), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) >= min_len) & ~t.isin(*STOP))


def doc_tokens(docs: DataFrame) -> Column:
    """Tokens of a document: the column `_t` of a table tokenised before, else from its text."""
    return F.col("_t") if "_t" in docs.columns else tokens(F.col("text"))


def tokenised(docs: DataFrame) -> DataFrame:
    """docs without text but with their tokens `_t`, written once for several lists."""
    return stage(spread(docs).withColumn("_t", tokens(F.col("text"))).drop("text"), "tokens")


def postings(docs: DataFrame, keep: DataFrame | None = None, carry: Sequence[str] = (), marker: bool = False) -> DataFrame:
    """(doc_id, token, tf, dl); `keep` restricts to the tokens some query needs before the shuffle.

    Occurrences are laid out by doc_id once; counting here and any later sum per
    (query, document) reuse that layout without another shuffle. With `marker` every
    document also has one row with an empty token, which carries its length.
    """
    toks = docs.select("doc_id", *carry, doc_tokens(docs).alias("_t"))
    if marker:
        rows = toks.select("doc_id", *carry, F.size("_t").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "_t")).alias("token"))
        keep = keep.select("token").union(keep.sparkSession.createDataFrame([("",)], "token string"))
    else:
        rows = toks.select("doc_id", *carry, F.size("_t").alias("dl"), F.explode("_t").alias("token"))
    if keep is not None:
        rows = rows.join(small(cut(keep.select("token").distinct())), "token", "left_semi").repartition("doc_id")
    return rows.groupBy("doc_id", *carry, "dl", "token").agg(F.count("*").alias("tf"))


def query_tokens(queries: DataFrame) -> DataFrame:
    rows = queries.select("query_id", *(["as_of"] if "as_of" in queries.columns else []), F.explode(tokens(F.col("text"))).alias("token"))
    return rows.groupBy(*[c for c in rows.columns]).agg(F.count("*").alias("qtf"))


def bm25_stats(qtok: DataFrame, posts: DataFrame) -> DataFrame:
    """df, n and avgdl of every query token as of the query's date.

    Document counts accumulate over first-visible dates per token, so each query reads
    its state by an as-of lookup; queries never meet documents here.
    """
    by_token = past_totals(posts.filter("vf is not null and token <> ''"), ["token"], "vf", {"df": F.lit(1)}, inclusive=True)
    sizes = posts.filter("vf is not null and token = ''").select("vf", "dl")
    whole = past_totals(sizes, [], "vf", {"n": F.lit(1), "len": F.col("dl")}, inclusive=True)
    got = asof_join(qtok, by_token, ["token"], "as_of", "vf", ["df"], strict=False)
    got = asof_join(got, whole, [], "as_of", "vf", ["n", "len"], strict=False)
    return got.withColumns({"df": F.coalesce("df", F.lit(0).cast("long")), "avgdl": F.try_divide(F.col("len"), F.col("n"))}).drop("len")


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Best k documents per query by (score, id); ranks are limited on the map side first."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_scored(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, block_docs: int = 128, seeds: int = 4) -> DataFrame:
    """(query_id, doc_id, score, n_postings) of the documents that can be among the k best of a query; all others are left unscored.

    Postings lie in blocks of about block_docs documents of neighbouring first-visible dates. The largest part a
    token can add in a block bounds every score in it: the sum over a query's tokens of (token, block) maxima. The
    `seeds` best blocks of a query by that bound are scored first; then only blocks whose bound reaches the k-th
    score found there. Joins are by (token, block), so a frequent token is many keys.
    """
    qtok = cut(query_tokens(queries))
    docs = docs if "_t" in docs.columns else spread(docs)
    posts = cut(postings(docs.withColumn("vf", visible_from()), qtok, ["vf"], marker=True))
    stats = bm25_stats(qtok, posts)
    idf = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weights = cut(stats.filter("df > 0").select("query_id", "as_of", "token", (F.col("qtf") * idf).alias("w"), F.greatest("avgdl", F.lit(1e-8)).alias("avgdl")))
    longest = weights.agg(F.max("avgdl")).first()[0]
    if longest is None:
        return queries.select("query_id").join(docs.select("doc_id")).select("query_id", "doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_postings")).limit(0)
    part = lambda avgdl: F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    sizes = posts.filter("token = '' and vf is not null")
    days = past_totals(sizes, [], "vf", {"before": F.lit(1)}).join(sizes.groupBy("vf").agg(F.count("*").alias("n")), "vf")
    days = small(cut(days.select("vf", F.floor(F.col("before") / block_docs).alias("at"), F.ceil(F.col("n") / block_docs).alias("parts"))))
    block = F.struct("at", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"))
    blocked = posts.filter("token <> ''").join(days, "vf").select("doc_id", "vf", "dl", "token", "tf", block.alias("block"))
    # a part grows with the mean length, so the largest mean bounds it for every query
    maxima = blocked.groupBy("token", "block").agg(F.max(part(F.lit(longest))).alias("m"), F.min("vf").alias("vf0"))
    bounds = cut(maxima.join(small(weights), "token").filter("vf0 <= as_of").groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("m")).alias("bound")))

    def scored(chosen: DataFrame) -> DataFrame:
        wanted = chosen.select("query_id", "block").join(small(weights), "query_id")
        j = blocked.join(wanted, ["token", "block"]).filter(F.col("vf") <= F.col("as_of"))
        return j.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * part(F.col("avgdl"))), 9).alias("score"), F.count("*").alias("n_postings"))

    first = bounds.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))).filter(F.col("_r") <= seeds)
    found = cut(scored(first))
    least = top_k(found, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(small(cut(least)), "query_id", "left")
    return found.unionByName(scored(rest.filter(F.col("bound") + 1e-6 >= F.coalesce("least", F.lit(0.0)))))


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 over the documents visible at each query's date, statistics included; exact, by bounds of posting blocks."""
    return top_k(bm25_scored(queries, docs, k, k1, b).drop("n_postings"), k)


def date_segments(totals: Sequence[int], growth: float = 1.25) -> list[tuple[int, int]]:
    """Runs (first, last) of query dates in which the number of visible tokens grows by at most the factor."""
    out, start = [], 0
    for i in range(1, len(totals) + 1):
        if i == len(totals) or totals[i] > growth * max(totals[start], 1):
            out.append((start, i - 1))
            start = i
    return out


def tfidf_vocabulary(queries: DataFrame, docs: DataFrame, n_terms: int = 512, growth: float = 1.25) -> DataFrame:
    """(as_of, token, df, n): the n_terms most frequent tokens among the documents visible at each query date, their document counts and the number of documents.

    Counts only grow with the date. Query dates are cut into segments in which the visible tokens grow little; the
    n-th count at a segment's first date bounds those of its later dates, so only tokens whose count at its last
    date reaches that bound are laid out over its dates: about n_terms of them, whatever the size of the vocabulary.
    Occurrences are summed per (token, first query date that sees them) with map-side combination.
    """
    dates = [r.as_of for r in queries.select("as_of").filter("as_of is not null").distinct().orderBy("as_of").collect()]  # one row for each calendar day asked
    shape = "as_of date, token string, df long, n long"
    if not dates:
        return queries.sparkSession.createDataFrame([], shape)
    days = F.array(*[F.lit(d) for d in dates])
    seen = docs.withColumn("vf", visible_from()).filter(F.col("vf") <= F.lit(dates[-1])).select(doc_tokens(docs).alias("_t"), F.size(F.filter(days, lambda d: d < F.col("vf"))).alias("_i"))
    both = F.explode(F.concat(F.transform("_t", lambda t: F.struct(t.alias("token"), F.lit(1).alias("c"), F.lit(0).alias("d"))),
                              F.transform(F.array_distinct("_t"), lambda t: F.struct(t.alias("token"), F.lit(0).alias("c"), F.lit(1).alias("d"))))).alias("x")
    added = cut(seen.select("_i", both).groupBy("x.token", "_i").agg(F.sum("x.c").alias("c"), F.sum("x.d").alias("d")))
    sizes = {r["_i"]: r for r in seen.groupBy("_i").agg(F.count("*").alias("n"), F.sum(F.size("_t")).alias("k")).collect()}
    docs_at, words_at = (np.cumsum([getattr(sizes[i], c) if i in sizes else 0 for i in range(len(dates))]).tolist() for c in ("n", "k"))
    segments = date_segments(words_at, growth)
    upto = lambda i, c: F.sum(F.when(F.col("_i") <= i, F.col(c)).otherwise(0))
    ends = cut(added.groupBy("token").agg(F.array(*[F.struct(F.lit(k).alias("seg"), upto(a, "c").alias("c0"), upto(a, "d").alias("d0"), upto(b, "c").alias("c1")) for k, (a, b) in enumerate(segments)]).alias("e")))
    rows = ends.select("token", F.inline("e")).filter("c1 > 0")
    bound = rows.withColumn("_r", F.row_number().over(Window.partitionBy("seg").orderBy(F.desc("c0"), "token"))).filter(F.col("_r") <= n_terms).groupBy("seg").agg(
        F.when(F.count("*") == n_terms, F.min("c0")).otherwise(0).alias("bound"))
    able = rows.join(F.broadcast(bound), "seg").filter("c1 >= bound").drop("bound", "c1")
    limits = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in segments])
    able = able.withColumn("_l", limits[F.col("seg")]).select("token", "seg", "c0", "d0", F.col("_l.a").alias("a"), F.col("_l.b").alias("b"))
    steps = able.join(added, "token").filter((F.col("_i") > F.col("a")) & (F.col("_i") <= F.col("b"))).groupBy("token", "seg").agg(F.collect_list(F.struct("_i", "c", "d")).alias("_s"))
    laid = able.join(steps, ["token", "seg"], "left").select("token", "c0", "d0", "_s", F.explode(F.sequence("a", "b")).alias("_i"))
    more = lambda c: F.coalesce(F.aggregate(F.filter("_s", lambda x: x["_i"] <= F.col("_i")), F.lit(0).cast("long"), lambda t, x: t + x[c]), F.lit(0))
    run = laid.select("token", "_i", (F.col("c0") + more("c")).alias("ctf"), (F.col("d0") + more("d")).alias("df")).filter("ctf > 0")
    top = run.withColumn("_r", F.row_number().over(Window.partitionBy("_i").orderBy(F.desc("ctf"), "token"))).filter(F.col("_r") <= n_terms)
    return top.select(days[F.col("_i")].alias("as_of"), "token", "df", F.array(*[F.lit(int(x)) for x in docs_at])[F.col("_i")].cast("long").alias("n"))


#: Cells of a block's largest matrix.
MAX_CELLS = 1 << 24


def tfidf_topk(queries: DataFrame, docs: DataFrame, k: int, n_terms: int = 512, max_queries: int = 2048) -> DataFrame:
    """Cosine over the n_terms most frequent tokens with smoothed idf, all statistics as of the query's date.

    Queries go in blocks of at most about max_queries, halved by key hash until queries x vocabulary stays within
    MAX_CELLS; a block's weights are one matrix over its vocabulary. Each block scans the documents once: token
    counts of a batch times the matrix give all products, and their squares times the squared idf of each date the norms.
    """
    spark = docs.sparkSession
    docs = docs if "_t" in docs.columns else tokenised(docs)
    vocab = cut(tfidf_vocabulary(queries, docs, n_terms))
    qtok = cut(query_tokens(queries))
    total, found = queries.count(), vocab.select("token").distinct().count()
    blocks = max(1, -(-total // max_queries), -(-total * found // MAX_CELLS))
    qtype, dtype = dict(queries.dtypes)["query_id"], dict(docs.dtypes)["doc_id"]
    rows = docs.withColumn("vf", visible_from()).filter("vf is not null").select("doc_id", "vf", doc_tokens(docs).alias("t"))
    out = None
    for i in range(blocks):
        mine = qtok.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        q = mine.join(vocab.select("as_of", "token"), ["as_of", "token"]).toPandas()
        if not len(q):
            continue
        v = vocab.join(mine.select("as_of").distinct(), "as_of", "left_semi").toPandas()
        words, days = {t: j for j, t in enumerate(sorted(set(v["token"])))}, {d: j for j, d in enumerate(sorted(set(v["as_of"])))}
        idf = np.zeros((len(days), len(words)))
        idf[v["as_of"].map(days), v["token"].map(words)] = np.log((1 + v["n"]) / (1 + v["df"])) + 1
        ids = sorted(set(q["query_id"]))
        at = q["query_id"].map({x: j for j, x in enumerate(ids)}).to_numpy()
        day = np.zeros(len(ids), dtype=int)
        day[at] = q["as_of"].map(days)
        w = np.zeros((len(ids), len(words)))
        w[at, q["token"].map(words)] = q["qtf"].to_numpy() * idf[day[at], q["token"].map(words)]
        w /= np.linalg.norm(w, axis=1, keepdims=True)
        limits = np.array(sorted(days), dtype="datetime64[D]")[day]
        shared = spark.sparkContext.broadcast((words, ids, day, limits, w * idf[day], idf**2))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            words, ids, day, limits, weights, squares = shared.value
            best_s, best_d = None, None
            for b in batches:
                for lo in range(0, len(b), 1024):
                    part = b.iloc[lo:lo + 1024]
                    tf = np.zeros((len(part), len(words)))
                    for r, t in enumerate(part["t"]):
                        hit = [words[x] for x in t if x in words]
                        np.add.at(tf[r], hit, 1.0)
                    s, norm = weights @ tf.T, np.sqrt(squares @ (tf**2).T)[day]
                    seen = (part["vf"].to_numpy(dtype="datetime64[D]")[None, :] <= limits[:, None]) & (s > 0)
                    s = np.where(seen, np.round(s / np.where(norm > 0, norm, 1), 9), -1.0)
                    d = np.broadcast_to(part["doc_id"].to_numpy(), s.shape)
                    if best_s is not None:
                        s, d = np.hstack([best_s, s]), np.hstack([best_d, d])
                    order = np.lexsort((d, -s), axis=1)[:, :k]
                    best_s, best_d = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
            if best_s is not None:
                keep = best_s.ravel() >= 0
                yield pd.DataFrame({"query_id": np.repeat(np.array(ids), best_s.shape[1])[keep], "doc_id": best_d.ravel()[keep], "score": best_s.ravel()[keep]})

        part = rows.mapInPandas(scan, f"query_id {qtype}, doc_id {dtype}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"query_id {qtype}, doc_id {dtype}, score double")
    return top_k(out, k)


def vector_topk(queries: DataFrame, docs: DataFrame, k: int, max_queries: int = 4096) -> DataFrame:
    """Exact inner-product search of L2-normalised vectors; with `as_of` on queries and `vf` on docs, of visible documents only.

    Queries (query_id, vec) travel as one matrix whose row count is checked; a larger
    query table is cut into blocks of about that size by key hash and each block scans the
    documents once. A task keeps k hits per query while it reads, so at most
    tasks * queries * k rows reach the final ranking.
    """
    spark = docs.sparkSession
    total = queries.count()
    blocks = max(1, -(-total // max_queries))
    dated = "as_of" in queries.columns and "vf" in docs.columns
    numbered = queries.select("query_id", "vec", *(["as_of"] if dated else []), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_b"))
    qtype, dtype = dict(queries.dtypes)["query_id"], dict(docs.dtypes)["doc_id"]
    rows = docs.filter("vf is not null").select("doc_id", "vec", "vf") if dated else docs.select("doc_id", "vec")
    out = None
    for i in range(blocks):
        pdf = numbered.filter(F.col("_b") == i).drop("_b").toPandas()
        if not len(pdf):
            continue
        q = np.asarray(pdf["vec"].tolist(), dtype=float)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((pdf["query_id"].tolist(), q, pdf["as_of"].to_numpy(dtype="datetime64[D]") if dated else None))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, qm, days = shared.value
            best_s, best_d = None, None
            for b in batches:
                if not len(b):
                    continue
                m = np.asarray(b["vec"].tolist(), dtype=float)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                s = np.round(qm @ m.T, 9)
                if days is not None:
                    s = np.where(b["vf"].to_numpy(dtype="datetime64[D]")[None, :] <= days[:, None], s, -np.inf)
                # only scores that reach the k-th best so far are sorted
                if best_s is not None and best_s.shape[1] == k:
                    reach = (s >= best_s[:, -1:]).any(axis=0)
                    s, b = s[:, reach], b[reach]
                d = np.broadcast_to(b["doc_id"].to_numpy(), s.shape)
                if best_s is not None:
                    s, d = np.hstack([best_s, s]), np.hstack([best_d, d])
                order = np.lexsort((d, -s), axis=1)[:, :k]
                best_s, best_d = np.take_along_axis(s, order, 1), np.take_along_axis(d, order, 1)
            if best_s is not None:
                keep = np.isfinite(best_s.ravel())
                yield pd.DataFrame({"query_id": np.repeat(np.array(ids), best_s.shape[1])[keep], "doc_id": best_d.ravel()[keep], "score": best_s.ravel()[keep]})

        part = rows.mapInPandas(scan, f"query_id {qtype}, doc_id {dtype}, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, k)


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Mean of the normalised vectors of each label, as query vectors."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.select(label, F.transform("vec", lambda x: x.cast("double")).alias("vec")).withColumn("_n", norm)
    dims = rows.select(label, F.posexplode(F.transform("vec", lambda x: x / F.greatest(F.col("_n"), F.lit(1e-12)))).alias("i", "x"))
    m = dims.groupBy(label, "i").agg(F.avg("x").alias("x"))
    return m.groupBy(F.col(label).alias("query_id")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("_v")).select("query_id", F.col("_v.x").alias("vec"))


def rrf(lists: Sequence[DataFrame], weights: Sequence[float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, doc_id, rank)."""
    u = None
    for d, w in zip(lists, weights or [1.0] * len(lists)):
        part = d.select("query_id", "doc_id", (float(w) / (k + F.col("rank"))).alias("part"))
        u = part if u is None else u.unionByName(part)
    return u.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 12).alias("score"))


def decay_rerank(scored: DataFrame, queries: DataFrame, docs: DataFrame, k: int, days: float = 30.0) -> DataFrame:
    """Score times exp(-age / days), age measured at the query's date."""
    j = scored.join(queries.select("query_id", "as_of"), "query_id").join(docs.select("doc_id", "pub_date"), "doc_id")
    age = F.greatest(F.datediff("as_of", "pub_date"), F.lit(0))
    return top_k(j.withColumn("score", F.round(F.col("score") * F.exp(-age / days), 15)).drop("as_of", "pub_date"), k)


def retrieve(queries: DataFrame, docs: DataFrame, k: int = 8, days: float = 30.0, dense: DataFrame | None = None, weights: Sequence[float] | None = None) -> DataFrame:
    """Visible documents: BM25, TF-IDF and, if given, dense lists (query_id, doc_id, rank) of 2k, fused, decayed, cut to k."""
    read = tokenised(docs)
    lists = [bm25_topk(queries, read, 2 * k), tfidf_topk(queries, read, 2 * k), *([dense] if dense is not None else [])]
    return decay_rerank(rrf(lists, weights), queries, docs, k, days)


def packages(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Ordered evidence per query with a token estimate of 1.3 per word."""
    j = hits.join(docs.select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).alias("_w")), "doc_id")
    g = j.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("chunks"), F.sum("_w").alias("_n"))
    return g.select("query_id", "chunks", F.floor(F.round(F.col("_n") * 1.3, 6)).cast("long").alias("tokens_est"))


def retrieval_truth(events: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents tied to an event date and published by the next day, as rows (event_date, as_of, doc_id).

    Rows belong to the date; events of a date share them by a join on it and no list is copied.
    """
    dates = events.select("event_date").distinct()
    tied = docs.filter(F.col("pub_date") <= F.date_add("event_date", 1)).select("event_date", "doc_id").distinct()
    return tied.join(dates, "event_date", "left_semi").select("event_date", F.date_add("event_date", 1).alias("as_of"), "doc_id")


def retrieval_quality(hits: DataFrame, truth: DataFrame, leaked: DataFrame | None = None) -> DataFrame:
    """Mean recall, reciprocal rank and citation coverage over queries with relevant documents."""
    rel = truth.select("query_id", "doc_id").distinct()
    nrel = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    nret = hits.groupBy("query_id").agg(F.count("*").alias("n_ret"))
    good = hits.join(rel, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n_hit"), F.min("rank").alias("first"))
    j = nrel.join(nret, "query_id", "left").join(good, "query_id", "left").fillna(0, ["n_ret", "n_hit"])
    out = j.agg(F.count("*").alias("n_queries"), F.avg(F.col("n_hit") / F.col("n_rel")).alias("recall_at_k"),
                F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
                (F.sum("n_hit") / F.greatest(F.sum(F.least("n_rel", "n_ret")), F.lit(1))).alias("citation_coverage"))
    bad = F.lit(0) if leaked is None else leaked.agg(F.count("*")).scalar()
    return out.withColumn("firewall_pass", (bad == 0).cast("int"))
