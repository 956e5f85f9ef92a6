"""A corpus from raw documents to packed sequences: five stages, each calling one operator.

Every stage works on all that the stage before kept, written as Parquet in the shared folder and
read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.llm import decontam, exact_dedup, langid, packing, simhash
from flowguard.llm.common import save


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document lies in the training sequences."""
    pieces = packing.pack(docs, with_ids=False)
    return pieces.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                         "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near),
          ("benchmark_decontamination", clean), ("packing", packed)]
#: Fitted models, fingerprints and token ids have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return save(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
