"""The corpus pipeline: quality, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm import jaccard, mixing, packing, quality, queries, secrets
from orebed.llm.scratch import Scratch


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one with the smallest doc_id.

    Of equal rows of that doc_id one stays; documents without words are no duplicates.
    """
    joined = jaccard.jaccard_components(docs.select("doc_id", "text"))
    heads = joined.where("doc_id <=> component_id").select("doc_id").distinct()
    kept = docs.join(heads.withColumnRenamed("doc_id", "head"), F.col("doc_id").eqNullSafe(F.col("head")), "left_semi")
    return kept.withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text_hash"]).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret in a text is replaced by a mark."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens, filled in the order of the mixture.

    A written table keeps no order when it is read again, so the places of the mixture, which
    depend on the rows alone, are found anew and rows packed by ranges of them.
    """
    return packing.pack(mixing.mixed(docs), queries.tokenizer_path())


STAGES = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secret_scan),
    ("source_mix", source_mix),
    ("packing", pack_sequences),
]

#: A trained classifier and tokenization have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
