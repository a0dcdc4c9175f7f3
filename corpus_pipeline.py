"""The corpus pipeline over `documents`: quality classifier, exact deduplication, near-duplicate
removal, benchmark decontamination and packing.

Each stage takes all rows that the one before it kept, in the columns of `documents`, and its decision
takes effect: rejected, repeated and contaminated documents go, and what stays is packed. `run` writes
every stage's result as Parquet to the shared checkpoint folder and reads it again, which cuts the
lineage, so a lost executor never repeats an earlier stage; a stage's table goes once the next one stands.

Empty tables, null and empty texts, ties and repeated rows are treated as the operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontaminate, exact_dedup, packing, quality, simhash
from lexmill.llm.common import checkpoint_dir, spread, table
from lexmill.session import remove


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; it learns from the labelled documents that aren't held out."""
    docs = spread(docs)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest doc_id."""
    return exact_dedup.exact_dedup(spread(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the smallest doc_id."""
    return simhash.near_dedup(spread(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminate(spread(docs), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packing.pack(spread(docs))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL has no zstandard, XXH64 or tokenizer; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}")
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}")  # nothing reads it any more
    return docs
