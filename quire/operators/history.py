"""What was valid when: the version of a document at each event, and what two versions differ in."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from quire.functions.running import renumber

# Events and versions of a document are put in order within stretches of this many seconds.
STRETCH = 86_400


def valid_at(events: DataFrame, versions: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``events`` (doc_id, at, ...) with the ``version`` and ``since`` of the document that held then.

    ``versions``: doc_id, version, since. The newest version that began at or before the event holds;
    of several that began together the largest. Events before the first version, and those without a
    time or document, get nulls. Both timestamps are merged into one order and the last version is
    carried forward: within a stretch of time by a window, across stretches by the last version of
    each. So a document's history is dealt over tasks, and only one row a stretch is put in order
    for the whole document.
    """
    block = lambda at: F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / stretch).alias("_blk")
    fields = F.struct("since", "version")
    known = versions.where("since IS NOT NULL AND doc_id IS NOT NULL").select(
        "doc_id", block("since"), F.col("since").cast("timestamp").alias("_at"), F.lit(0).alias("_kind"), fields.alias("_held"),
        F.lit(None).cast(events.schema).alias("_event"),
    )
    asked = events.select(
        "doc_id", block("at"), F.col("at").cast("timestamp").alias("_at"), F.lit(1).alias("_kind"),
        F.lit(None).cast(known.schema["_held"].dataType).alias("_held"), F.struct(*events.columns).alias("_event"),
    )
    # The last version of each stretch, carried to the stretches that follow.
    ends = known.groupBy("doc_id", "_blk").agg(F.max("_held").alias("_last"))
    needed = asked.select("doc_id", "_blk").distinct()
    before = Window.partitionBy("doc_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        needed.join(ends, ["doc_id", "_blk"], "full")
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
        .where("_carry IS NOT NULL")
        .select("doc_id", "_blk", "_carry")
    )
    # Of equal times the version comes first, and of several the largest last.
    order = ["_at", "_kind", "_held"]
    inside = Window.partitionBy("doc_id", "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = known.unionByName(asked).withColumn("_now", F.last("_held", ignorenulls=True).over(inside)).where("_kind = 1")
    now = F.coalesce("_now", "_carry")
    return held.join(carried, ["doc_id", "_blk"], "left").select("_event.*", now["version"].alias("version"), now["since"].alias("since"))


class Difference(NamedTuple):
    added: DataFrame
    dropped: DataFrame
    kept: DataFrame


def manifest_difference(before: DataFrame, after: DataFrame, identity: tuple[str, ...] = ("src_doc", "src_page", "rotation")) -> Difference:
    """Pages that ``after`` has and ``before`` has not, the other way round, and in both.

    Both are manifests (out_doc, position, ...). Pages are told apart by ``identity`` (nulls are equal)
    and counted: of three copies before and one after, two are dropped, the later ones. ``added`` has
    the new position, ``dropped`` the old one, ``kept`` both (``position``, ``was``).
    """
    key = ["out_doc", *identity]

    def numbered(manifest: DataFrame) -> DataFrame:
        return renumber(manifest.select("position", *key), key, ["position"], "copy")

    old, new = numbered(before), numbered(after)
    pages = lambda df: df.select(*key, "copy")
    names = [*key, "copy"]

    def placed(found: DataFrame, manifest: DataFrame, name: str) -> DataFrame:
        there = manifest.select(F.col("position").alias(name), *[F.col(c).alias(f"_{c}") for c in names])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
        return found.join(there, same).drop(*[f"_{c}" for c in names])

    added = placed(pages(new).exceptAll(pages(old)), new, "position")
    dropped = placed(pages(old).exceptAll(pages(new)), old, "position")
    kept = placed(placed(pages(old).intersectAll(pages(new)), new, "position"), old, "was")
    return Difference(added, dropped, kept)
