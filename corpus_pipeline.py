"""Corpus pipeline: quality, near-duplicates, contamination, personal data, mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` applies them to the documents
table, each stage written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.functions.lineage import stage
from evq.llm import decontam, mixing, neardup, pii, quality
from evq.llm.common import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.8): that with the smallest id."""
    return neardup.first_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than the allowed share of benchmark passages."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data generalised and disclosing terms removed."""
    cleaned = pii.sanitised_documents(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their calibrated probability, which is returned with the topic and tokens."""
    mixed = mixing.mix(docs)
    m = mixed.columns[-1]
    return mixed.filter(F.col(m)["drawn"]).select(*docs.columns, F.col(m)["topic"].alias("mix_topic"), F.col(m)["tokens"].alias("mix_tokens"), F.round(F.col(m)["probability"], 6).alias("mix_probability"))


STAGES = [("quality classifier", quality_stage), ("simhash near-dedup", dedup_stage), ("benchmark decontamination", decontaminate_stage), ("personal data", personal_data_stage), ("source mixing", mixing_stage)]

#: The classifier's and fingerprints' numeric methods have no SQL form; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
