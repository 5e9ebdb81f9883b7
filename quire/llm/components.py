"""Connected components of a link table, and comparing the members of buckets in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import store

BLOCK = 128  # members of a bucket compared with as many others at once


def connected(links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) of every id in ``links(a, b)``.

    Labels fall to the smallest label around, then jump to their label's label; the rounds grow
    with the logarithm of the longest path. Every round is a table in the shared folder.
    """
    ways = store(links.select("a", "b").unionByName(links.selectExpr("b AS a", "a AS b")).distinct(), "ways")
    labels = store(ways.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        around = (
            ways.join(labels.selectExpr("id AS b", "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        )
        fallen = labels.join(around.withColumnRenamed("a", "id"), "id").select(
            "id", "label", F.least("label", "near").alias("fallen")
        )
        jump = labels.selectExpr("id AS fallen", "label AS jumped")
        moved = store(
            fallen.join(jump, "fallen").select("id", F.col("label").alias("was"), F.least("fallen", "jumped").alias("label")),
            "labels",
        )
        labels = moved.select("id", "label")
        if moved.where("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component")


def compare_in_buckets(
    members: DataFrame, compare: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
) -> DataFrame:
    """Pairs ``a < b`` of members that share a bucket and pass ``compare``.

    ``members`` has ``bucket, n`` (its size), ``id, mark`` (long) and ``payload`` (binary); only
    payloads of one length are compared. A bucket is split into blocks of about ``BLOCK`` members by
    a hash of the id, and every two blocks meet in one group, so no group grows with the bucket.
    ``compare`` gets the bucket, and marks and payloads (rows of bytes) of both sides, and gives a
    boolean matrix; nothing but the pairs it accepts leaves a task.
    """
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (
        members.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "mark",
            "payload", F.octet_length("payload").alias("size"),
        )
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j", "size")
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in source:
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            starts = _starts(table)
            whole = int(starts[-1])  # the last group may go on in the next batch
            if whole:
                yield from _groups(table.slice(0, whole), starts, compare, schema)
            held = table.slice(whole).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from _groups(table, np.append(_starts(table), len(table)), compare, schema)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _starts(table: pa.Table) -> np.ndarray:
    """First row of every group."""
    changed = np.zeros(len(table), bool)
    changed[:1] = True
    for name in ("bucket", "i", "j", "size"):
        column = table[name].to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(changed)


def _groups(table, starts, compare, schema):
    bucket, ids, marks, own, i, j, size = (
        table[c].to_numpy() for c in ("bucket", "id", "mark", "own", "i", "j", "size")
    )
    flat = np.frombuffer(b"".join(table["payload"].to_pylist()), np.uint8)
    place = np.cumsum(size, dtype=np.int64) - size
    lefts, rights = [], []
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if end - begin < 2:
            continue
        group, width = slice(begin, end), int(size[begin])
        payload = flat[place[begin] : place[begin] + width * (end - begin)].reshape(end - begin, width)
        key, mark, block = ids[group], marks[group], own[group]
        same = i[begin] == j[begin]
        x, y = (slice(None),) * 2 if same else (block == i[begin], block == j[begin])
        good = compare(int(bucket[begin]), mark[x], payload[x], mark[y], payload[y])
        good &= (key[x][:, None] < key[y][None]) if same else (key[x][:, None] != key[y][None])
        p, q = np.nonzero(good)
        lefts.append(key[x][p])
        rights.append(key[y][q])
    if lefts:
        a, b = np.concatenate(lefts), np.concatenate(rights)
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], schema=schema)
