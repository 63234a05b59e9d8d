"""From raw documents to packed sequences: five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``.  Run one after another, each result is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelog.llm import decontaminate, jaccard, packing, quality, secrets
from cuelog.session import shared_folder


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the base rules, or whose source is rejected."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 in 100 of their five-word shingles, or are linked by such, the one with the smallest id.

    Rows with one id are one document, and one row of it stays.  Rows without an id
    cannot be named as another's copy and all stay.
    """
    groups = jaccard.jaccard_components(docs.select("doc_id", "text"), words=5, percent=80)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a ten-word window of a test item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = decontaminate.decontaminate(docs.select(F.struct("*").alias("_row"), "text"), items)
    return marked.filter(~F.col("contaminated")).select("_row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by their kind in brackets."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document, placed in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", good_documents), ("near duplicates", one_of_each_group), ("decontamination", without_test_items),
          ("secrets", without_secrets), ("packing", packed)]

#: Tokenising and packing cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; stages are cut with tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs
