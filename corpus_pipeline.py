"""A corpus pipeline over ``documents``: stages, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents its predecessor kept; all but
the last return the columns of ``documents``. SQL cannot state the first stage (a fitted model), so
there is no ``ORACLE_SQL``; the stages are tested one by one against plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import lines, minhash, packing, quality
from quire.llm.shared import ship, store


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier does not reject."""
    ship(spark)
    return quality.filter_documents(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; those left empty by it go."""
    ship(spark)
    return lines.dedup_lines(docs, drop_emptied=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, linked from a similarity of 0.8."""
    ship(spark)
    return minhash.dedup(docs, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 2,048 tokens."""
    ship(spark)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
