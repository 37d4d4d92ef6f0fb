"""Registered queries of the subpackage: op<N>_<name> over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm import decontam, exactdedup, hardneg, hmm, html, merkle, mixing, oracles, pii, quality, rules, simhash, tokencount, warc
from evq.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_source_mixing", oracles.MIXING)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked probability and whether it was drawn."""
    m = mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "mixture.*")
    return m.select("doc_id", "topic", "tokens", F.round("probability", 6).alias("probability"), "drawn")


@query("op3_simhash_components")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits().alias("fingerprint"), "component_id")


@query("op4_benchmark_contamination", oracles.CONTAMINATION)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op6_quality_posterior", oracles.QUALITY)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("quality_model.p_quality", 6).alias("p_quality"), F.col("quality_model.kept").alias("kept"))


@query("op9_personal_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents")).select("doc_id", "pii")
    code = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"] != "term")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(code(base), 256).alias("base_sha256"), code(F.col("pii")).alias("spans"))


@query("op1_warc_revisits", oracles.WARC)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write archives of all pages, read them back, resolve revisits."""
    kind = table(spark, sf_dir, "pages").schema["page_id"].dataType
    found = warc.archive(table(spark, sf_dir, "pages"))
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return found.select(number("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


#: Name of a vocabulary file of the public tokenizers.
VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


@query("op5_transducer_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


@query("op7_boosted_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), *rules.BASE, "base_failed", "kept")


@query("op8_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op10_hidden_markov_score")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op11_exact_duplicates", oracles.EXACT)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    found = exactdedup.duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op12_hard_negatives", oracles.NEGATIVES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; the labels of every seventh are moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op13_merkle_manifest", oracles.MERKLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and roots of every document; a third of the documents is checked with a tampered text."""
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, fields(F.translate("text", UPPER, LOWER)))
    leaves = docs.select("doc_id", "lang", fields(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    found = merkle.manifest(leaves, "doc_id", "lang").select("doc_id", "leaf", "tampered", "merkle.*")
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), merkle.folded(F.coalesce("tampered", "leaf")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
