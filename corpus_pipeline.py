"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and
read again as the next one's documents. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starcell.llm import jaccard, mixing, packing, quality, queries, suffixes
from starcell.llm.shared import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return quality.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five words, similarity of 0.75)."""
    return jaccard.keep_one(docs, 5, 75)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what strings of 200 bytes that occur twice cover; none is dropped."""
    return suffixes.cut_repeats(docs, 200).withColumn("n_chars", F.length("text").cast("bigint"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that bring the sources to their target weights, each once at most."""
    mixed = mixing.mix(docs, queries.mix_tree(), queries.mix_tokens(), queries.MIX_SHARE, 1, queries.MIX_SEED)
    return mixed.drop("__epoch")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's ids lies in sequences of 2048."""
    return packing.pack(docs, queries.BPE_50K, 2048, end_id=0)


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("suffix_dedup", suffix_dedup),
          ("source_mix", source_mix), ("best_fit_packing", best_fit_packing)]

# Hashes of shingles and byte strings, and the tokenizer, are not for SQL; tests/llm compares
# the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
