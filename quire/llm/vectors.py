"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A vector is normalised, padded to a power of two, and rotated at random three times over: signs
flipped, then a fast Hadamard transform. The hash is the signed axis it lies closest to; three such
hashes make a bucket, ten tables have rotations of their own. Multiprobe: each vector is also put
into the next best buckets of every table, those whose axes lie a little farther. For vectors at a
cosine of 0.95 (64 dimensions) a pair escapes with a probability of some 1e-5.

Equal vectors are one member with a count. Members of a bucket are compared in blocks by their
cosine in double precision, and only true links leave a task, so a link is never a guess.

Vectors that are null, empty or zero, or hold null or non-finite components, and vectors of another
length link with nothing. ``vec_id`` has to be an integer that names a vector; repeated rows of it
are one vector. Rows with a null ``vec_id`` are not compared and kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import compare_in_buckets, connected
from quire.llm.shared import store

COSINE = 0.95
TABLES, HASHES, PROBES = 10, 3, 4
NEAREST = 3  # axes of a rotation that probes choose from


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Orthonormal Hadamard transform of each row; the length is a power of two."""
    n, d = rows.shape
    step = 1
    while step < d:
        halves = rows.reshape(n, d // (2 * step), 2, step)
        rows = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return rows / np.sqrt(d)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two first, so that no square overflows or is lost."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1, keepdims=True))
    rows = np.ldexp(rows, -exponent)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def buckets(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Bucket keys of unit vectors: rows by (tables * probes)."""
    n, d = unit.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = unit
    signs = np.random.default_rng(95).choice([-1.0, 1.0], size=(tables, hashes, 3, width))
    nearest = min(NEAREST, width)
    probes = min(probes, nearest**hashes)
    out = np.empty((n, tables * probes), dtype=np.int64)
    for table in range(tables):
        keys, costs = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1))
        for k in range(hashes):
            turned = padded
            for sign in signs[table, k]:
                turned = hadamard(turned * sign)
            size = np.abs(turned)
            axes = np.argpartition(-size, nearest - 1, axis=1)[:, :nearest]
            far = np.take_along_axis(size, axes, 1)
            lost = (far.max(axis=1, keepdims=True) - far) ** 2
            code = 2 * axes + (np.take_along_axis(turned, axes, 1) < 0)
            keys = (keys[:, :, None] * (2 * width) + code[:, None, :]).reshape(n, -1)
            costs = (costs[:, :, None] + lost[:, None, :]).reshape(n, -1)
        best = np.argsort(costs, axis=1, kind="stable")[:, :probes]
        chosen = np.take_along_axis(keys, best, 1)
        out[:, table * probes : (table + 1) * probes] = (chosen * tables + table) * 4099 + d
    return out


def _hashed(members: DataFrame) -> DataFrame:
    """``id, keys, payload`` of every member ``id, vector``; the payload is the vector's bytes and its keys'."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, vectors = batch.column(0), batch.column(1)
            lengths = np.asarray(pc.list_value_length(vectors))
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                flat = np.asarray(vectors.take(pa.array(rows)).flatten(), dtype=np.float64).reshape(len(rows), d)
                for at in range(0, len(rows), 1024):
                    part = flat[at : at + 1024]
                    keys = buckets(unit(part))
                    payload = [v.tobytes() + k.tobytes() for v, k in zip(part, keys, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows[at : at + 1024])), pa.array(list(keys), pa.list_(pa.int64())), pa.array(payload, pa.binary())],
                        names=["id", "keys", "payload"],
                    )

    return members.select("id", "vector").mapInArrow(run, "id long, keys array<long>, payload binary")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``."""
    wide = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, x -> double(x))").alias("vector")
    )
    sound = wide.where(
        "vec_id IS NOT NULL AND size(vector) > 0 AND exists(vector, x -> x <> 0)"
        " AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    )
    # -0.0 and 0.0 are one value.
    sound = sound.withColumn("vector", F.expr("transform(vector, x -> x + 0.0D)"))
    members = store(
        sound.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies")), "members"
    )
    hashed = store(_hashed(members), "hashed")
    entries = hashed.select("id", F.explode("keys").alias("bucket"))
    full = store(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = entries.join(full, "bucket").join(hashed.select("id", "payload"), "id").withColumn("mark", F.lit(0).cast("long"))
    tail = 8 * TABLES * PROBES

    def close(bucket, mark_x, x, mark_y, y):
        p, q = (np.ascontiguousarray(v[:, :-tail]).view(np.float64) for v in (x, y))
        good = unit(p) @ unit(q).T >= cosine
        a, b = np.nonzero(good)
        keys_x, keys_y = (np.ascontiguousarray(v[:, -tail:]).view(np.int64).reshape(len(v), TABLES, PROBES) for v in (x, y))
        for at in range(0, len(a), 4096):
            left, right = keys_x[a[at : at + 4096]][..., None], keys_y[b[at : at + 4096]][..., None, :]
            least = np.where(left == right, left, np.iinfo(np.int64).max).min(axis=(1, 2, 3))
            # A pair is given out in the least bucket that both are in, and nowhere else.
            good[a[at : at + 4096], b[at : at + 4096]] = least == bucket
        return good

    links = store(compare_in_buckets(met, close), "links")
    found = connected(links)

    counts = members.select("id", "copies")
    ways = links.unionByName(links.selectExpr("b AS a", "a AS b"))
    beside = (
        ways.join(counts.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    )
    told = (
        members.select("vector", "id", "copies")
        .join(found, "id", "left")
        .join(beside.withColumnRenamed("a", "id"), "id", "left")
        .select(
            "vector",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    told = store(told, "told")
    named = F.expr("if(vec_id IS NOT NULL, transform(vector, x -> x + 0.0D), NULL)")
    rows = wide.withColumn("vector", named).join(told, "vector", "left")
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
