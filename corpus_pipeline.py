"""A corpus from documents to token files in five stages; each is written as Parquet and read by the next.

Toxic documents go, one document of each near-duplicate class stays, documents with benchmark passages
go, the rest is sampled to target shares, and what is left is written as token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import fresh_folder
from llm.decontamination import find_overlaps
from llm.ngram_jaccard import jaccard_components
from llm.source_mixing import mix
from llm.token_files import token_digest
from llm.toxicity import THRESHOLD, scored_documents


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return scored_documents(docs, labels, "_toxicity").where(F.col("_toxicity") < THRESHOLD).drop("_toxicity")


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All but the documents that are near duplicates of one with a smaller id; rows without an id stay."""
    classes = jaccard_components(docs)
    others = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(others, docs.doc_id == F.col("_other"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without passages of the benchmark; rows without an id stay."""
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = find_overlaps(docs, benchmark).select(F.col("doc").alias("_found")).distinct()
    return docs.join(found, docs.doc_id == F.col("_found"), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """A sample with the target shares of source, language and layout."""
    return mix(docs, names=("_tokens", "_probability", "_kept")).where("_kept").drop("_tokens", "_probability", "_kept")


def token_files(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Place, length and checksum of each document in the token files."""
    return token_digest(spark, docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("token_files", token_files)]

#: The learned scores, hashed seeds and the tokenizer have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of ``folder``; returns the last one's rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        target = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, folder).write.parquet(target)
        docs = spark.read.parquet(target)
    return STAGES[-1][1](spark, docs, folder)
