"""Dot products of many rows with many queries, inside Spark tasks.

Spark partitions the rows; a task multiplies blocks of them with blocks of
queries and keeps, per query, the best rows it has seen. What leaves a task is
at most ``k`` rows per query as long as the queries fit one block, and per block
of rows beyond that; nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.sources.scratch import scratch_folder

# Rows multiplied at a time; also bounds how many tied rows are ever held.
BLOCK_ROWS = 1024


def sparse_matrix(column: str, dims: int) -> Callable:
    """Reader for an array<struct<bucket,weight>> column."""

    def read(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column(column)
        values = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        out = np.zeros((len(lists), dims))
        out[row, values.field("bucket").to_numpy(zero_copy_only=False)] = values.field(
            "weight"
        ).to_numpy(zero_copy_only=False)
        return out

    return read


def unit_matrix(column: str, dims: int) -> Callable:
    """Reader for a dense array column, rows scaled to length one."""

    def read(batch: pa.RecordBatch) -> np.ndarray:
        flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float)
        rows = flat.reshape(len(batch), dims)
        norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return rows / np.where(norm > 0, norm, 1.0)

    return read


def _packed(column: str, limit: int) -> Callable:
    """Task that turns its rows into Arrow streams of at most ``limit`` rows, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), limit):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, limit))
                stream = pa.array([sink.getvalue().to_pybytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([stream], names=[column])

    return run


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _counted_blocks(queries: DataFrame, limit: int) -> tuple[DataFrame, int]:
    stored = _stored(queries, f"{scratch_folder(queries.sparkSession)}/queries")
    blocks = max(1, -(-stored.count() // limit))
    return stored.repartition(blocks).mapInArrow(_packed("queries", limit), "queries binary"), blocks


def query_blocks(queries: DataFrame, limit: int = BLOCK_ROWS) -> DataFrame:
    """Queries packed into blocks, each in a task of its own.

    The queries are stored first: a product computes a side again for each partition of the
    other, and their number says how many blocks they make.
    """
    return _counted_blocks(queries, limit)[0]


def paired_blocks(rows: DataFrame, queries: DataFrame, limit: int = BLOCK_ROWS) -> DataFrame:
    """``rows, queries``: every block of rows beside every block of queries, as Arrow streams.

    The rows' blocks are stored if the queries make more than one, so that whatever makes the
    rows runs once.
    """
    asked, blocks = _counted_blocks(queries, limit)
    packed = rows.mapInArrow(_packed("rows", limit), "rows binary")
    if blocks > 1:
        packed = _stored(packed, f"{scratch_folder(queries.sparkSession)}/rows")
    return packed.crossJoin(asked)


def best_matches(
    rows: DataFrame,
    read: Callable,
    keep: list[str],
    order: list[str],
    queries: DataFrame,
    read_queries: Callable,
    k: int | None = None,
    floor: float = 0.0,
    zeros: bool = False,
) -> DataFrame:
    """``keep`` columns, query_id and score of every pair worth ranking.

    The queries, any number of them, are a table too: rows and queries are
    packed into blocks, each block of rows meets each block of queries, and a
    task multiplies the two. With ``k`` it returns its best ``k`` rows per query,
    ties by ``order``; without it every pair that reaches ``floor``. Scores are
    clamped to [0, 1] and rounded to twelve places before anything is compared.
    Pairs that score zero are left out unless ``zeros``.
    """
    types = dict(rows.dtypes)
    id_type = dict(queries.dtypes)["query_id"]
    id_arrow = to_arrow_type(T.DataType.fromDDL(id_type))
    limit = BLOCK_ROWS

    # Nested like the readers, so that they are shipped whole and workers need no package install.
    def unpacked(stream: bytes) -> pa.RecordBatch:
        return pa.ipc.open_stream(stream).read_next_batch()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Query ids, kept columns and scores of two blocks; the ids object is the same while the queries are."""
        seen, ids, weights = None, None, None
        for batch in batches:
            for stream, block in zip(batch.column(0), batch.column(1), strict=True):
                asked = block.as_py()
                if asked != seen:
                    part = unpacked(asked)
                    seen, ids, weights = asked, part.column("query_id").cast(id_arrow), read_queries(part).T.copy()
                part = unpacked(stream.as_py())
                scores = np.round(np.clip(read(part) @ weights, 0.0, 1.0), 12)
                yield ids, pa.Table.from_batches([part]).select(keep), scores

    def shaped(held: pa.Table, ids: pa.Array, query: np.ndarray, score: np.ndarray) -> list[pa.RecordBatch]:
        full = held.append_column("query_id", ids.take(pa.array(query))).append_column("score", pa.array(score))
        return full.combine_chunks().to_batches()

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held, scores in met(batches):
            row, query = np.nonzero((scores >= floor) & (zeros | (scores > 0)))
            if len(row):
                yield from shaped(held.take(pa.array(row)), ids, query, scores[row, query])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept, query, score, bar = None, None, None, None, None
        for ids, held, scores in met(batches):
            if ids is not current:
                if kept is not None:
                    yield from shaped(kept, current, query, score)
                current, kept, query, score = ids, None, np.empty(0, int), np.empty(0)
                bar = np.full(len(ids), floor)
            n = len(scores)
            reach = np.partition(scores, n - k, axis=0)[n - k] if n > k else bar
            row, found = np.nonzero((scores >= np.maximum(bar, reach)) & (zeros | (scores > 0)))
            if not len(row):
                continue
            fresh = held.take(pa.array(row))
            kept = fresh if kept is None else pa.concat_tables([kept, fresh])
            query = np.concatenate([query, found])
            score = np.concatenate([score, scores[row, found]])
            ranked = kept.select(order).to_pandas().assign(_q=query, _s=score)
            ranked = ranked.sort_values(["_q", "_s", *order], ascending=[True, False, *[True] * len(order)])
            nth = ranked.groupby("_q").cumcount()
            top = ranked.index[nth < k].to_numpy()
            kept = kept.take(pa.array(top)).combine_chunks()
            query, score = query[top], score[top]
            full = ranked[nth == k - 1]
            bar[full["_q"].to_numpy()] = full["_s"].to_numpy()
        if kept is not None:
            yield from shaped(kept, current, query, score)

    blocks = paired_blocks(rows, queries, limit)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", query_id {id_type}, score double"
    return blocks.mapInArrow(best if k else every, schema)
