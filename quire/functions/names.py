"""Making names unique in order, without gathering a group or a family of names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.running import BLOCK, renumber, running_total

#: A number as it is given out: from 2, without leading zeros.
NUMBER = "(?:[2-9]|[1-9][0-9]+)"


def number_path(tail: Column) -> Column:
    """The numbers at the end of a name, outer ones last; sorts by value, a name before its forms."""
    numbers = F.regexp_extract_all(tail, F.lit("([0-9]+)"), 1)
    return F.transform(numbers, lambda n: F.struct(F.length(n).alias("size"), n.alias("digits")))


def settle_names(
    rows: DataFrame,
    group: list[str],
    order: list[str],
    name: str,
    out: str,
    root: Column,
    path: Column,
    numbered: Callable[[Column, Column], Column],
) -> DataFrame:
    """Add ``out``: the name, or its first free numbered form when taken.

    ``root`` and ``path`` take a name apart: numbering the root with the numbers of
    the path, one after the other, gives the name, and no other root and path do.

    Rows of one name are counted off in blocks, the name itself being number 1. What
    disturbs the count is that a form is wanted by rows of its own. The row that comes
    to the form's number either finds it taken, and it and all later rows move on by
    one, or takes it, and all rows that want the form move on by one. Which of the two
    follows from how many rows of the name come before the first one that wants the
    form, so only such pairs of distinct names are walked in order; where a count
    moves on is then added up in blocks again.
    """
    key = [*group, name]
    names = (
        rows.groupBy(*key)
        .agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_root", root)
        .withColumn("_path", path)
    )
    forms = names.where(F.size("_path") > 0).select(
        *group, "_root", F.col("_path").alias("_form_path"), F.col(name).alias("_form"), "_first",
        F.expr("slice(_path, 1, size(_path) - 1)").alias("_path"),
    )
    pairs = names.drop("_first").join(forms, [*group, "_root", "_path"])
    marks = pairs.select(*key, *[F.col("_first")[c].alias(c) for c in order], "_root", "_rows", "_form", "_form_path")
    # Rows meet such names by block, or all rows of a name would meet in one task.
    seen = rows.withColumn("_blk", F.floor(F.col(order[0]) / BLOCK).cast("long"))
    blocks = seen.select(*key, "_blk").distinct().join(pairs.select(*key).distinct(), key, "left_semi")
    counted = seen.join(blocks, [*key, "_blk"], "left_semi").select(*key, *order)
    before = running_total(
        counted.unionByName(marks, allowMissingColumns=True), key, order,
        F.when(F.col("_form").isNull(), 1).otherwise(0), "_before",
    ).where("_form is not null")
    steps = (
        before.select(*group, "_root", "_form_path", name, "_rows", "_form", F.col("_before").cast("long"))
        .repartition(*group, "_root")
        .sortWithinPartitions(*group, "_root", "_form_path")
    )
    kinds = rows.select(*key).schema
    walked = steps.mapInArrow(
        _walk(len(group), to_arrow_schema(kinds)),
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", _n long",
    )
    moves = walked.groupBy(*key, "_n").agg(F.count("*").alias("_move")).withColumn("_row", F.lit(0))
    placed = renumber(rows, key, order, "_n").withColumn("_row", F.lit(1)).withColumn("_part", F.floor(F.col("_n") / BLOCK).cast("long"))
    # Most names have no form that is wanted: their number is their place. A name has a row at the start of each block.
    starts = placed.where(F.col("_n") == F.col("_part") * BLOCK).select(*key, "_part")
    moved = starts.join(moves.select(*key).distinct(), key, "left_semi")
    plain = placed.join(moved, [*key, "_part"], "left_anti").withColumn("_moved", F.lit(0).cast("long")).drop("_part")
    both = placed.join(moved, [*key, "_part"], "left_semi").drop("_part").unionByName(moves, allowMissingColumns=True)
    settled = running_total(both, key, ["_n", "_row"], F.coalesce("_move", F.lit(0)), "_moved").where("_row = 1").drop("_move")
    number = F.col("_n") + F.col("_moved") + 1
    return plain.unionByName(settled).withColumn(
        out, F.when(number == 1, F.col(name)).otherwise(numbered(F.col(name), number.cast("string")))
    ).drop("_n", "_row", "_moved")


def _walk(n_group: int, kinds: pa.Schema) -> Callable:
    """Task over pairs of a name and its wanted form, forms in order of their paths.

    Gives the name and the position among its rows from which they move on by one.
    Only the names above the present form are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, above = None, []  # (path, moves so far) of the names that the last form came from
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            found = []
            for row in zip(*columns, strict=True):
                own, steps, (name, n_rows, form, before) = row[: n_group + 1], row[n_group + 1], row[n_group + 2 :]
                path = [s["digits"] for s in steps]
                if own != family:
                    family, above = own, []
                while above and above[-1][0] != path[: len(above[-1][0])]:
                    above.pop()
                if not above or len(above[-1][0]) < len(path) - 1:
                    above.append([path[:-1], 0])
                # Longer numbers are past the end of any table.
                at = int(path[-1]) - 1 - above[-1][1] if len(path[-1]) < 19 else n_rows
                taken = False
                if at < n_rows:
                    taken = before > at
                    if not taken:
                        above[-1][1] += 1
                    found.append((*own[:-1], form if taken else name, 0 if taken else at))
                above.append([path, int(taken)])
            if found:
                arrays = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), [*kinds.types, pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kinds.names, "_n"])

    return run
