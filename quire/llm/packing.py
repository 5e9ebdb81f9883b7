"""Packing tokenised documents into sequences of a fixed length by the sum-of-squares rule.

Documents are cut into pieces of at most ``capacity`` tokens: only longer ones are cut, the first
piece takes what is left over. Whole pieces fill a sequence each. The others are dealt by a hash
of the document into groups of some thousands and packed there, longest first: a piece goes into
the open sequence for which the sum over residual gaps of (number of open sequences with that
gap) squared becomes smallest, and opens a sequence only where none has room. The groups are
packed independently, so tasks grow in number, not in size; each loses a fraction of a percent.

Nulls and repeats: a null text is empty (one token, the end mark). Rows with the same ``doc_id``
are packed row by row. A null ``doc_id`` is a value like any other. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import units
from quire.llm.shared import batches

CAPACITY = 2048
GROUP = 4096  # documents packed together, on average
END = b"\0\0\0\0"  # id 0 closes every document


def coded(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, crcs[, ids]``: tokens of each whole text with the end mark.

    ``crcs`` has the CRC-32 of each piece's ids, ``ids`` the ids as little-endian 32-bit numbers.
    """
    kind = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
         T.StructField("crcs", T.ArrayType(T.LongType()))]
        + [T.StructField("ids", T.BinaryType())] * with_ids
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units.kept("ids", path, lambda texts: units.unit_ids(path, texts))
        for batch in source:
            keys, texts = batch.column(0), batch.column(1)
            schema = pa.schema(
                [("doc_id", keys.type), ("n_tokens", pa.int64()), ("crcs", pa.list_(pa.int64()))]
                + [("ids", pa.binary())] * with_ids
            )
            yield from batches(_code(keys, texts, known, path, capacity, with_ids), schema)

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def _code(keys, texts, known, path, capacity, with_ids):
    for begin, end in units.byte_slices(texts):
        part = [t or "" for t in texts.slice(begin, end - begin).to_pylist()]
        cut = [None if units.SPECIAL in t else units.blocks(t) for t in part]
        known.learn([block for blocks in cut if blocks for block in blocks])
        for key, text, blocks in zip(keys.slice(begin, end - begin).to_pylist(), part, cut, strict=True):
            if blocks is None:
                ids = units.ids_bytes(path, [text])[0] + END
            else:
                ids = b"".join([b"".join(known.values(block)) for block in blocks]) + END
            n = len(ids) // 4
            bounds = [0, *range(first_length(n, capacity) * 4, len(ids) + 1, capacity * 4)]
            view = memoryview(ids)
            crcs = [zlib.crc32(view[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield (key, n, crcs, ids) if with_ids else (key, n, crcs)


def first_length(n: int, capacity: int) -> int:
    """Tokens in the first piece of a document of n tokens."""
    return (n - 1) % capacity + 1


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, packed longest first by sums of squares.

    ``open_[g]`` counts the open sequences with gap g. Moving one of gap g down to g - s changes
    the sum of squares by 2 (open_[g - s] - open_[g]) + 2, and by 1 - 2 open_[g] where it is filled.
    """
    open_ = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    never = np.iinfo(np.int64).max
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        gap = 0
        if s < capacity:
            change = 2 * (open_[: capacity - s] - open_[s:capacity]) + 2
            change[0] = 1 - 2 * open_[s]
            change[open_[s:capacity] == 0] = never
            best = int(change.argmin())
            gap = best + s if change[best] != never else 0
        if gap:
            sequence = stacks[gap].pop()
            open_[gap] -= 1
        else:
            sequence, gap = made, capacity
            made += 1
        where[i], offset[i] = sequence, capacity - gap
        if gap > s:
            open_[gap - s] += 1
            stacks[gap - s].append(sequence)
    return where, offset


def pack(counted: DataFrame, n_docs: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces of documents with ``n_tokens`` and ``crcs`` and their places.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    """
    groups = max(1, math.ceil(n_docs / group))
    key = counted.schema["doc_id"].dataType
    kind = T.StructType(
        [T.StructField("doc_id", key)]
        + [T.StructField(n, T.LongType()) for n in ("n_tokens", "sequence_id", "offset", "whole_id")]
        + [T.StructField("crcs", T.ArrayType(T.LongType()))]
    )

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        n = np.asarray(order["n_tokens"])
        first = (n - 1) % capacity + 1
        where, offset = place(first, capacity)
        used = int(where.max()) + 1 if len(where) else 0
        whole = (n - first) // capacity
        number = int(order["part"][0].as_py()) << 40
        return pa.table(
            {
                "doc_id": order["doc_id"],
                "n_tokens": order["n_tokens"],
                "sequence_id": pa.array(where + number),
                "offset": pa.array(offset),
                "whole_id": pa.array(np.cumsum(whole) - whole + used + number),
                "crcs": order["crcs"],
            }
        )

    dealt = counted.select(
        "doc_id", "n_tokens", "crcs", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("part")
    )
    placed = dealt.groupBy("part").applyInArrow(run, kind)
    first = F.expr(f"(n_tokens - 1) % {capacity} + 1")
    return placed.select("*", F.posexplode("crcs").alias("piece", "ids_crc32")).select(
        "doc_id",
        "piece",
        F.when(F.col("piece") == 0, F.lit(0).cast("long"))
        .otherwise(first + (F.col("piece") - 1) * F.lit(capacity)).cast("long").alias("start"),
        F.when(F.col("piece") == 0, first).otherwise(F.lit(capacity)).cast("long").alias("length"),
        "ids_crc32",
        F.when(F.col("piece") == 0, F.col("sequence_id"))
        .otherwise(F.col("whole_id") + F.col("piece") - 1).cast("long").alias("sequence_id"),
        F.when(F.col("piece") == 0, F.col("offset")).otherwise(F.lit(0).cast("long")).alias("offset"),
    )


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pack whole documents; see the module's head for the rule and ``pack`` for the columns."""
    return pack(coded(docs, path, capacity), docs.count(), capacity, group)


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids`` (binary, 32-bit little-endian), for training.

    ``doc_id`` has to be unique here, as the ids are joined back by it.
    """
    with_ids = coded(docs, path, capacity, with_ids=True)
    placed = pack(with_ids.drop("ids"), docs.count(), capacity, group)
    cut = F.expr("substring(ids, cast(start * 4 + 1 AS int), cast(length * 4 AS int))")
    return (
        placed.join(with_ids.select("doc_id", "ids"), "doc_id")
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", cut.alias("ids")))).alias("parts"))
        .select("sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))
    )
