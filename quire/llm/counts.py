"""Token counts of whole texts with a two-tier lookup on the map side.

First tier: a table of the most frequent units' token counts, broadcast to all tasks. It is found
in one pass in which every task counts its own units and passes on only its most frequent ones, so
no pre-token is shuffled; its size is bounded by ``table`` units of at most ``units.LONG`` characters.
Second tier: units that miss it are coded by the library once per worker process and kept. Which units are in the table changes only the
speed, never a count.

A null text is empty (0 tokens, 0 bytes). Every row gives one row, also repeated ones and those
with a null ``doc_id``. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import units
from quire.llm.shared import batches

TABLE = 32_768  # units in the broadcast table
PER_TASK = 4_096  # most frequent units each task passes on
COUNTED = 200_000  # units a task counts at once; the rarer half is let go beyond it


def frequent_units(docs: DataFrame, table: int = TABLE, per_task: int = PER_TASK) -> list[str]:
    """The most frequent units of the corpus, as far as tasks can tell in bounded memory."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        for batch in source:
            for text in batch.column(0):
                text = text.as_py() or ""
                if units.plain(text):
                    for block in units.pieces(text):
                        counted.update(u for u in block[1:] if len(u) <= units.LONG)
                if len(counted) > COUNTED:
                    counted = Counter(dict(counted.most_common(COUNTED // 2)))
        schema = pa.schema([("unit", pa.string()), ("n", pa.int64())])
        yield from batches(counted.most_common(per_task), schema)

    found = docs.select("text").mapInArrow(run, "unit string, n long")
    top = found.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(table)
    return [r["unit"] for r in top.collect()]


def token_counts(docs: DataFrame, path: str, limit: int = 512, table: int = TABLE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row."""
    known = frequent_units(docs, table)
    lengths = [len(i) for i in units.encode(path, [units.literal(u) for u in known])]
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(known, lengths, strict=True)))
    kind = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()),
         T.StructField("n_tokens", T.LongType())]
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiers = units.kept("lengths", path, lambda texts: [len(i) // 4 for i in units.unit_ids(path, texts)], shared.value)
        for batch in source:
            keys, texts = batch.column(0), batch.column(1)
            schema = pa.schema([("doc_id", keys.type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
            yield from batches(_count(keys, texts, tiers, path), schema)

    counted = docs.select("doc_id", "text").mapInArrow(run, kind)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def _count(keys, texts, tiers, path):
    sizes = pc.fill_null(pc.binary_length(texts), 0)
    for begin, end in units.byte_slices(texts):
        part = [t or "" for t in texts.slice(begin, end - begin).to_pylist()]
        cut = [None if units.SPECIAL in t else units.blocks(t) for t in part]
        tiers.learn([block for blocks in cut if blocks for block in blocks])
        rows = zip(keys.slice(begin, end - begin).to_pylist(), sizes.slice(begin, end - begin).to_pylist(), part, cut, strict=True)
        for key, size, text, blocks in rows:
            if blocks is None:
                n = len(units.encode(path, [text])[0])
            else:
                n = sum(sum(tiers.values(block)) for block in blocks)
            yield key, size, n
