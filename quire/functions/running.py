"""Running totals and row numbers that survive one very large group.

A plain window puts a whole group in one task. Here the group is cut into
blocks of consecutive order values: blocks are totalled (partial aggregation),
only the block totals are summed in order, and the per-row window then runs
inside ``(group, block)``. Groups with a single block need no offset at all, so
the offset side is empty or tiny for ordinary data and the join is adaptive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 8192


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    name: str,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows of the group.

    ``order[0]`` is a non-negative integer; the rest break ties within it.
    """
    marked = df.withColumn("_blk", F.floor(F.col(order[0]) / block).cast("long")).withColumn(
        "_val", value
    )
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        marked.groupBy(*keys, "_blk")
        .agg(F.sum("_val").alias("_tot"))
        .withColumn("_off", F.sum("_tot").over(before))
        .where("_off is not null")
        .select(*keys, "_blk", "_off")
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    zero = F.lit(0)
    return (
        marked.join(offsets, [*keys, "_blk"], "left")
        .withColumn(
            name,
            F.coalesce(F.sum("_val").over(inside), zero) + F.coalesce(F.col("_off"), zero),
        )
        .drop("_blk", "_val", "_off")
    )


def renumber(
    df: DataFrame, keys: list[str], order: list[str], name: str, block: int = BLOCK
) -> DataFrame:
    """Add ``name``: the zero-based position of the row within its group."""
    return running_total(df, keys, order, F.lit(1), name, block).withColumn(
        name, F.col(name).cast("long")
    )
