"""Readers for the engine's input tables. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGES_SCHEMA = "doc_id STRING, doc_name STRING, page INT, text STRING"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page-text table: one canonical string per page, pages counted from 1."""
    return spread(spark.read.schema(PAGES_SCHEMA).parquet(path))


def stream_pages(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same table as a stream of newly written files."""
    return (
        spark.readStream.schema(PAGES_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Raw files as ``path, name, size, content`` for intake and type checks.

    Two folders may hold files of one name; ``path`` tells them apart.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .selectExpr(
            "path", "element_at(split(path, '/'), -1) AS name", "length AS size", "content"
        )
    )


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than the session has cores.

    Text work is CPU-bound, and a small file of one row group would keep it in
    one task. Large inputs have splits enough and pass through without a shuffle.
    Only for plain scans: asking for the split count runs no job there.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
