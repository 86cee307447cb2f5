"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

Every stage works on all rows its predecessor kept, takes (spark, docs, sf_dir)
and returns a DataFrame.  All but the last return the columns of ``documents``.
Edge cases (nulls, empty and repeated rows, empty tables) are those of the
operators, which see every row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortica.llm import common, decontam, jaccard, mixing, quality, sharding

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, which learns from the table ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).where("predicted = 1").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of least id of each group linked by 0.8 of their five-word shingles."""
    return jaccard.keep_one(docs, n=5, num=8, den=10).select(*COLUMNS)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the table ``benchmark``."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy the curriculum takes, in training order."""
    return mixing.mix(docs).select(*COLUMNS)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every copy; slots follow the training order, which is that of the files and their rows."""
    ordered = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return sharding.shard(ordered, SHARDS, order=(F.col("_file"), F.col("_row")))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", keep_clean_of_benchmark),
    ("mixing to target weights", mix_sources),
    ("sharding", deal_shards),
]

#: The learned classifier cannot be written in SQL; tests hold stages 2 to 4 against brute force, 5 by its invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        path = f"{common.workspace(spark).rstrip('/')}/pipeline-{number}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        if number:
            common.discard(docs)
        docs = spark.read.parquet(path)
    raise AssertionError("no stage")
