"""Hard negatives by inner product, found with length buckets and pruning by coordinates.

Anchors are compared with all rows in cells: a group of anchors (some ``ANCHORS``) meets a share of
the rows (at most some ``ROWS``), which stream by from the longest vector to the shortest and are cut
into buckets. A bucket has its longest length and, for every coordinate, a list of its rows sorted by
value. An anchor passes a bucket if its own length times the bucket's cannot reach the score that it
still needs; as lengths fall and that score rises, anchors drop out for good. Otherwise the score
bounds the angle to the anchor, and with it the values that a row may have in the anchor's largest
(focus) coordinates: the shortest of these ranges in the sorted lists gives candidates, the other ranges
cut them, and only these rows are verified. Where no range cuts a bucket down, all of it is verified at once.

The search runs twice: for the best rows of the anchor's label, then for rows of other labels whose
scores lie between shares of each positive's. Cells give back a few rows for each anchor, which are
ranked again over all cells. Nothing holds more than a bucket, a group of anchors and their lists.

Scores are exact integers. Rows with a null ``vec_id``, label or vector, with null or non-finite
components, or with components beyond 2^31 / sqrt(length) after scaling (whose products would not fit
in a long) take no part. Vectors of different lengths do not meet. Of rows with one ``vec_id`` the
least label, then the least vector counts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import store

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95  # percent of the positive's score that a negative's may have
ANCHORS, ROWS, BUCKET = 1 << 14, 1 << 17, 2048
FOCUS = 3
_AT_ONCE = 1024  # anchors whose scores with a bucket are held at a time
_NONE = -(1 << 62)


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, v, d, length``: one row of whole numbers for each id that takes part."""
    x = F.transform("embedding", lambda e: F.lit(float(scale)) * e.cast("double"))
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")
    )
    rows = rows.where(
        "size(x) > 0 AND forall(x, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) <= 2147483647D / sqrt(size(x)))"
    ).select("vec_id", "label", F.transform("x", lambda e: F.floor(e).cast("int")).alias("v"))
    once = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v")
    return once.withColumn("d", F.size("v")).withColumn(
        "length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e))
    )


class Bucket:
    """Rows of about one length with their sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, longest: float):
        self.ids, self.labels, self.rows, self.longest = ids, labels, rows, longest
        self.flat = rows.astype(np.float64)
        self.most = int(np.abs(rows).max(initial=0))
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(rows, self.order, 0)


class Anchors:
    """A group of anchors and, for each, the best rows so far of every list it keeps.

    List ``k`` of an anchor takes scores from ``low`` to ``cap`` of rows of the anchor's label, or of
    other labels, and keeps the ``keep`` best.
    """

    def __init__(self, ids, labels, rows, low, cap, keep: int, same: bool):
        self.ids, self.labels, self.rows, self.low, self.cap = ids, labels, rows, low, cap
        self.keep, self.same = keep, same
        self.flat = rows.astype(np.float64)
        self.length = np.sqrt((self.flat**2).sum(axis=1))
        self.most = int(np.abs(rows).max(initial=0))
        self.focus = np.argsort(-np.abs(rows), axis=1, kind="stable")[:, :FOCUS]
        self.best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        open_lists = low <= cap
        self.need = np.where(open_lists, low, 1 << 62)  # what a row must reach to enter a list
        self.least, self.top = self.need.min(axis=1), np.where(open_lists, cap, _NONE).max(axis=1)

    def meet(self, bucket: Bucket) -> None:
        reach = self.length * bucket.longest * (1 + 1e-9) + 1
        active = np.flatnonzero(reach >= self.least)
        for at in range(0, len(active), _AT_ONCE):
            some = active[at : at + _AT_ONCE]
            lows, highs, first, last = self._ranges(some, bucket)
            size = last - first
            shortest = size.argmin(axis=1)
            pruned = size.min(axis=1) < len(bucket.ids) // 8
            for i in np.flatnonzero(pruned).tolist():
                self._verify(int(some[i]), bucket, lows[i], highs[i], int(first[i, shortest[i]]), int(last[i, shortest[i]]), int(shortest[i]))
            if not pruned.all():
                self._all(some[~pruned], bucket)

    def _ranges(self, some, bucket):
        """Values that rows may have in each focus coordinate, and where the sorted lists hold them."""
        focus = self.focus[some]
        length = np.maximum(self.length[some], 1e-300)
        q = np.take_along_axis(self.flat[some], focus, 1) / length[:, None]
        longest = max(bucket.longest, 1e-300)
        widest = np.arccos(np.clip((self.least[some] - 1) / length / longest, -1, 1))[:, None]
        own = np.arccos(np.clip(q, -1, 1))
        slack = 1e-6 * longest + 1e-6
        lows = np.cos(np.minimum(np.pi, own + widest)) * longest - slack
        highs = np.cos(np.maximum(0, own - widest)) * longest + slack
        first, last = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            here = focus == f
            first[here] = np.searchsorted(bucket.sorted[:, f], lows[here], "left")
            last[here] = np.searchsorted(bucket.sorted[:, f], highs[here], "right")
        return lows, highs, first, last

    def _verify(self, a: int, bucket: Bucket, lows, highs, first: int, last: int, by: int) -> None:
        found = bucket.order[first:last, self.focus[a, by]]
        for k, f in enumerate(self.focus[a].tolist()):
            if k != by and len(found):
                values = bucket.rows[found, f]
                found = found[(values >= lows[k]) & (values <= highs[k])]
        if len(found):
            scores = bucket.rows[found] @ self.rows[a]
            fit = (bucket.labels[found] == self.labels[a]) == self.same
            fit &= (bucket.ids[found] != self.ids[a]) & (scores >= self.least[a]) & (scores <= self.top[a])
            self._enter(a, scores[fit], bucket.ids[found[fit]])

    def _all(self, some, bucket: Bucket) -> None:
        exact = self.rows.shape[1] * self.most * bucket.most < 1 << 53
        scores = self.flat[some] @ bucket.flat.T if exact else self.rows[some] @ bucket.rows.T
        fit = (self.labels[some][:, None] == bucket.labels) == self.same
        fit &= (self.ids[some][:, None] != bucket.ids) & (scores >= self.least[some][:, None]) & (scores <= self.top[some][:, None])
        for i in np.flatnonzero(fit.any(axis=1)).tolist():
            self._enter(int(some[i]), scores[i, fit[i]].astype(np.int64), bucket.ids[fit[i]])

    def _enter(self, a: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for k in range(self.low.shape[1]):
            mine = (scores >= self.need[a, k]) & (scores <= self.cap[a, k])
            if not mine.any():
                continue
            old = self.best.get((a, k))
            s, i = (scores[mine], ids[mine]) if old is None else (np.append(old[0], scores[mine]), np.append(old[1], ids[mine]))
            first = np.lexsort((i, -s))[: self.keep]
            self.best[a, k] = s[first], i[first]
            if len(first) == self.keep:
                self.need[a, k] = s[first[-1]]
        self.least[a] = self.need[a].min()

    def found(self) -> Iterator[tuple[int, int, int, int]]:
        for (a, k), (scores, ids) in self.best.items():
            for score, other in zip(scores.tolist(), ids.tolist(), strict=True):
                yield int(self.ids[a]), k, other, score


def _search(anchors: DataFrame, rows: DataFrame, keep: int, same: bool) -> DataFrame:
    """``anchor_id, list, other_id, score`` of ``vec_id, label, v, d, length, low, cap`` against all rows, cell by cell."""
    spark = rows.sparkSession
    n_rows, n_anchors = rows.count(), anchors.count()
    groups = max(1, -(-n_anchors // ANCHORS))
    spread = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups)
    shares = max(1, -(-n_rows // ROWS), min(spread, n_rows // BUCKET))
    none = F.lit(None).cast("array<bigint>")
    left = anchors.select(
        "d", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("g"),
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("h"), F.lit(0).alias("kind"), "length", "vec_id", "label", "v", "low", "cap",
    )
    right = rows.select(
        "d", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"),
        F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int").alias("h"), F.lit(1).alias("kind"), "length", "vec_id", "label", "v",
        none.alias("low"), none.alias("cap"),
    )
    schema = pa.schema([("anchor_id", pa.int64()), ("list", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for told in _cells(source, keep, same):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told, strict=True)], schema=schema)

    cells = left.unionByName(right).repartition(max(1, min(groups * shares, 20_000)), "d", "g", "h")
    cells = cells.sortWithinPartitions("d", "g", "h", "kind", F.desc("length"), "vec_id")
    return cells.mapInArrow(run, "anchor_id long, list long, other_id long, score long")


def _cells(source: Iterator[pa.RecordBatch], keep: int, same: bool) -> Iterator[list[tuple]]:
    """What each cell of a task found; rows come sorted by cell, anchors first, then by falling length."""
    cell, held, anchors, rows = None, [], None, []

    def bucket():
        nonlocal rows
        if rows and anchors is not None:
            ids, labels, v, length = (np.concatenate(c) for c in zip(*rows, strict=True))
            anchors.meet(Bucket(ids, labels, v, float(length.max())))
        rows = []

    def closed():
        bucket()
        return list(anchors.found()) if anchors is not None else []

    for batch in source:
        for part, key, kind in _runs(batch):
            if key != cell:
                told = closed()
                if told:
                    yield told
                cell, held, anchors, rows = key, [], None, []
            ids, labels, length = (np.asarray(part.column(c)) for c in ("vec_id", "label", "length"))
            v = np.asarray(part.column("v").flatten(), dtype=np.int64).reshape(len(ids), key[0])
            if kind == 0:
                low, cap = (np.asarray(part.column(c).flatten(), np.int64).reshape(len(ids), -1) for c in ("low", "cap"))
                held.append((ids, labels, v, low, cap))
                continue
            if held:
                anchors, held = Anchors(*(np.concatenate(c) for c in zip(*held, strict=True)), keep, same), []
            at = 0
            while at < len(ids):
                room = BUCKET - sum(len(r[0]) for r in rows)
                rows.append((ids[at : at + room], labels[at : at + room], v[at : at + room], length[at : at + room]))
                at += room
                if sum(len(r[0]) for r in rows) >= BUCKET:
                    bucket()
    told = closed()
    if told:
        yield told


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tuple[int, int, int], int]]:
    """Stretches of a batch that belong to one cell and kind."""
    names = ("d", "g", "h", "kind")
    keys = np.stack([np.asarray(batch.column(c)) for c in names])
    cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end > begin:
            d, g, h, kind = keys[:, begin].tolist()
            yield batch.slice(begin, end - begin), (d, g, h), kind


def _best(found: DataFrame, by: list[str], keep: int) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= keep)


def positives(rows: DataFrame, anchors: DataFrame, keep: int = POSITIVES) -> DataFrame:
    """``anchor_id, positive_id, score``: each anchor's best other rows of its label."""
    limits = anchors.withColumn("low", F.array(F.lit(_NONE))).withColumn("cap", F.array(F.lit(-_NONE)))
    return _best(_search(limits, rows, keep, same=True), ["anchor_id"], keep).select(
        "anchor_id", F.col("other_id").alias("positive_id"), "score"
    )


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
    lowest: int = LOWEST, highest: int = HIGHEST,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` as of ``prepared``, ``anchors`` some of them. For each anchor and positive the best
    ``n_negatives`` rows of other labels with ``lowest * positive <= 100 * negative <= highest * positive``.
    """
    near = store(positives(rows, anchors, n_positives), "positives")
    told = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.array_sort(F.collect_list(F.struct("positive_id", "score"))).alias("near")
    )
    # Lists are padded to one width; a padded list takes nothing.
    filled = F.concat("near", F.array_repeat(F.lit(None).cast("struct<positive_id: bigint, score: bigint>"), F.lit(n_positives) - F.size("near")))
    # Negatives of a negative score do not exist: its bounds are 1 and 0. Hundreds and rest apart, so that nothing overflows.
    share = "(p.score div 100) * {0} + ((p.score % 100) * {0} + {1}) div 100"
    limits = (
        ("low", f"if(p.score >= 0, {share.format(lowest, 99)}, 1L)"),
        ("cap", f"if(p.score >= 0, {share.format(highest, 0)}, 0L)"),
    )
    low, cap = (F.expr(f"transform(filled, p -> {rule})").alias(name) for name, rule in limits)
    asked = store(
        anchors.join(told, "vec_id").withColumn("filled", filled).select(*anchors.columns, "near", low, cap),
        "asked",
    )
    found = store(_best(_search(asked, rows, n_negatives, same=False), ["anchor_id", "list"], n_negatives), "negatives")
    named = asked.select(F.col("vec_id").alias("anchor_id"), F.posexplode("near").alias("list", "p"))
    return found.join(named, ["anchor_id", "list"]).select(
        "anchor_id", F.col("p.positive_id").alias("positive_id"), "rank", F.col("other_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def relabelled(vectors: DataFrame) -> DataFrame:
    """``embeddings`` with the label of every seventh id moved on by one, modulo ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", moved.alias("label"), "embedding")
