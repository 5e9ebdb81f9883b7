"""Near-duplicate documents by min-max hashing, banding and confirmation on whole shingle sets.

Each of 63 permutations of the shingle hashes gives two values of a document's signature, its
minimum and its maximum, so 126 values cost half the hash evaluations. 125 of them make 25 bands
of five; documents that share a band meet in a bucket. At a similarity of 0.85 a pair escapes all
bands with probability 4e-7.

Documents with the same set are one class and stand for each other from the start, so a group of
copies is one member of its buckets. Confirmation is in two rounds, both on full sets:

1. every member against the smallest member of each of its buckets;
2. where a bucket still holds members of different components, every two of those whose longer
   signatures (of 256 more permutations, made for such members only) agree as far as a similarity of
   the threshold less four standard errors would let them (a true link is left out with probability
   3e-5, and only if nothing else joins the two).

So links inside a component are not all listed, which the classes do not need.

``doc_id`` has to be an integer that names a document; repeated rows of it are one document. Rows
with a null ``doc_id`` are not compared: each is its own class with a null ``component_id``, kept.
Texts without words (and null ones) link with nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import bloom, shingles, units
from quire.llm.components import compare_in_buckets, connected
from quire.llm.shared import store

PERMUTATIONS, BANDS, ROWS = 63, 25, 5
WIDTH = 2 * PERMUTATIONS
LONGER = 256  # permutations of the second round
PERCENT = 85

_rng = np.random.default_rng(7)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    odd = _rng.integers(1, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, _rng.integers(0, 1 << 63, size=n, dtype=np.uint64)


_BANDED, _LONGER = _permutations(PERMUTATIONS), _permutations(LONGER)
# Bands mix minima and maxima of different permutations.
_ORDER = _rng.permutation(WIDTH)[: BANDS * ROWS].reshape(BANDS, ROWS)
_C = _rng.integers(1, 1 << 63, size=(BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "doc_id long, n_shingles long, class binary, bands array<long>"


def signatures(sets: list[np.ndarray], permutations: tuple = _BANDED) -> np.ndarray:
    """Minima and maxima of every set (none empty) under each permutation, as rows."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets])[:-1]
    n = len(permutations[0])
    out = np.empty((len(sets), 2 * n), dtype=np.uint64)
    for k, (odd, shift) in enumerate(zip(*permutations, strict=True)):
        values = flat * odd + shift
        out[:, k] = np.minimum.reduceat(values, starts)
        out[:, n + k] = np.maximum.reduceat(values, starts)
    return out


def _bytes(values: np.ndarray) -> list[bytes]:
    """Signatures with one byte of each value."""
    return [row.tobytes() for row in (shingles.mix(values) >> np.uint64(56)).astype(np.uint8)]


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's own factors tell bands apart."""
    return shingles.mix((shingles.mix(values)[:, _ORDER] * _C).sum(axis=2, dtype=np.uint64))


def signed(docs: DataFrame) -> DataFrame:
    """``SIGNED`` for every row; class and bands are null where there are no words."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys = batch.column(0).cast(pa.int64())
            for begin, end in units.byte_slices(batch.column(1)):
                yield _sign(keys.slice(begin, end - begin), batch.column(1).slice(begin, end - begin).to_pylist())

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def _sign(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    sets = shingles.shingle_sets(texts)
    full = [i for i, s in enumerate(sets) if len(s)]
    classes, listed = [None] * len(sets), [None] * len(sets)
    for i, s in enumerate(sets):
        if len(s):
            classes[i] = hashlib.md5(s.tobytes(), usedforsecurity=False).digest()
    if full:
        keyed = bands(signatures([sets[i] for i in full])).view(np.int64).tolist()
        for row, i in enumerate(full):
            listed[i] = keyed[row]
    return pa.RecordBatch.from_arrays(
        [keys, pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()),
         pa.array(listed, pa.list_(pa.int64()))],
        names=["doc_id", "n_shingles", "class", "bands"],
    )


def _sets(docs: DataFrame) -> DataFrame:
    """``id, items``: the shingle sets of ``docs(id, text)``."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for begin, end in units.byte_slices(batch.column(1)):
                sets = shingles.shingle_sets(batch.column(1).slice(begin, end - begin).to_pylist())
                items = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), items], names=["id", "items"]
                )

    return docs.mapInArrow(run, "id long, items array<long>")


def _longer(sets: DataFrame) -> DataFrame:
    """``id, payload``: the longer signatures of ``sets(id, items, bands)``, and the bands behind them."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                items = [np.asarray(v.values).view(np.uint64) for v in part.column(1)]
                keys = [np.asarray(v.values).tobytes() for v in part.column(2)]
                payload = [s + k for s, k in zip(_bytes(signatures(items, _LONGER)), keys, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(payload, pa.binary())], names=["id", "payload"])

    return sets.mapInArrow(run, "id long, payload binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs ``a, b`` whose full sets reach the threshold."""
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    either = F.size("x") + F.size("y") - both
    return pairs.join(one, "a").join(two, "b").where(100 * both >= percent * either).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``doc_id, text``."""
    prints = store(signed(docs), "prints")
    classes = store(
        prints.where("class IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("class").agg(F.min("doc_id").alias("id")),
        "classes",
    )
    stands = prints.join(classes, (prints["doc_id"] == classes["id"]) & (prints["class"] == classes["class"]))
    stands = store(stands.select("id", "bands"), "stands")
    entries = stands.select("id", F.explode("bands").alias("bucket"))
    buckets = store(
        entries.groupBy("bucket")
        .agg(F.min("id").alias("pivot"), F.max("id").alias("top"), F.count("*").alias("n"))
        .where("pivot < top").drop("top"),
        "buckets",
    )
    members = store(entries.join(buckets, "bucket"), "members")
    wanted = store(members.select("id").distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id")
    sets = store(_sets(texts.select("id", "text")), "sets")

    stars = store(members.where("id <> pivot").selectExpr("pivot AS a", "id AS b").distinct(), "stars")
    links = store(confirmed(stars, sets, percent), "links")
    found = connected(links)

    # Buckets that still hold different components.
    told = members.where("n > 2").join(found, "id", "left").withColumn("mark", F.coalesce("component", "id"))
    told = store(told.select("bucket", "id", "mark"), "told")
    mixed = store(
        told.groupBy("bucket").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.count("*").alias("n"))
        .where("low < high").select("bucket", "n"),
        "mixed",
    )
    rest = store(told.join(mixed, "bucket"), "rest")
    wide = sets.join(rest.select("id").distinct(), "id").join(stands, "id").select("id", "items", "bands")
    rest = rest.join(_longer(wide), "id")
    least = _least_agreeing(percent)

    def alike(bucket, mark_x, x, mark_y, y):
        good = mark_x[:, None] != mark_y[None]
        keys_x, keys_y = (np.ascontiguousarray(v[:, 2 * LONGER :]).view(np.int64) for v in (x, y))
        band = int(np.flatnonzero(keys_x[0] == bucket)[0])
        p, q = np.nonzero(good)
        for at in range(0, len(p), 2048):
            a, b = p[at : at + 2048], q[at : at + 2048]
            near = (x[a, : 2 * LONGER] == y[b, : 2 * LONGER]).sum(axis=1) >= least
            # Two that share an earlier band meet there.
            near &= ~(keys_x[a, :band] == keys_y[b, :band]).any(axis=1)
            good[a, b] = near
        return good

    more = store(compare_in_buckets(rest, alike).join(stars, ["a", "b"], "left_anti"), "more")
    links = links.unionByName(confirmed(more, sets, percent))
    found = connected(links)

    classes_of = store(
        classes.join(found, "id", "left").select("class", F.coalesce("component", "id").alias("component")), "of"
    )
    rows = prints.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
    return rows.join(classes_of, "class", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _least_agreeing(percent: int) -> int:
    """Signature values that agree in a pair at the threshold, less four standard errors."""
    share = percent / 100
    return int(np.floor(2 * LONGER * (share - 4 * (share * (1 - share) / (2 * LONGER)) ** 0.5)))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, one of each component, with all their columns."""
    gone = near_duplicates(docs, percent).where("NOT kept").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("__gone"))
    gone = store(gone, "gone")
    passed, maybe = bloom.split(docs, "doc_id", gone)
    return passed.unionByName(maybe.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti"))
