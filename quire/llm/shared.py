"""Intermediate tables in the cluster's shared folder, and small helpers."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.sources.scratch import scratch_folder

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application.

    Tasks import it; a session that was started elsewhere need not have it on its workers' path.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="quire-")) / "quire_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, as the core's intermediate tables have it.

    Where the setting is absent on a single machine (tests) it goes below the session's warehouse; a
    cluster without the setting is refused.
    """
    return scratch_folder(spark)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: short lineage, known size."""
    path = f"{folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``size``."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, type=field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)],
        schema=schema,
    )
