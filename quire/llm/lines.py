"""Line de-duplication by overlapping windows of three consecutive lines.

Lines are cut at ``\\n`` and compared without blanks, tabs and carriage returns at their ends; blank
lines take no part and stay. Every three consecutive lines of a document form a window, known by a
128-bit hash. Windows that occur more than once in the whole corpus are found by an aggregation
that first combines on the map side; the first occurrence, by ``doc_id`` and then by position,
stays. Each later occurrence covers its three lines, and the union of what is covered is taken out. Only
documents that may have such lines (a Bloom filter of their ids tells) are shuffled to meet them;
the others pass straight through.

A document whose lines are all taken out is left with an empty text, or dropped with
``drop_emptied``. Documents with fewer than three lines, null texts and rows with a null ``doc_id``
pass unchanged. ``doc_id`` names a document: repeated rows of it are the same document and keep the
same lines. Other columns pass unchanged, but for ``n_chars`` if present, which is counted again
where the text changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import bloom, units
from quire.llm.shared import store

WINDOW = 3
_ENDS = r"' \t\r\u000B\f'"
_COVERED = "__covered"


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``id, at, places, one, two``: windows of ``doc_id, text``, numbers of their lines, and hashes."""
    lines = F.expr(
        rf"filter(transform(split(text, '\n'), (l, i) -> struct(btrim(l, {_ENDS}) AS l, i AS i)), x -> x.l <> '')"
    )
    forth = ", ".join(f"lines[k + {j}].l" for j in range(width))
    back = ", ".join(f"lines[k + {j}].l" for j in reversed(range(width)))
    places = ", ".join(f"lines[k + {j}].i" for j in range(width))
    made = (
        f"transform(sequence(0, size(lines) - {width}), k -> struct(lines[k].i AS at, array({places}) AS places,"
        f" xxhash64({forth}) AS one, xxhash64('back', {back}) AS two))"
    )
    return (
        docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
        .select(F.col("doc_id").alias("id"), lines.alias("lines"))
        .where(F.size("lines") >= width)
        .select("id", F.inline(F.expr(made)))
    )


def covered(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``id, lines``: numbers (from 0) of the lines to take out of each document with repeats."""
    found = store(windows(docs, width), "windows")
    first = F.min(F.struct("id", "at"))
    repeated = store(
        found.groupBy("one", "two").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "repeated",
    )
    later = found.join(repeated, ["one", "two"]).where("id <> first.id OR at <> first.at")
    return store(
        later.select("id", F.explode("places").alias("line")).groupBy("id").agg(F.collect_set("line").alias("lines")),
        "covered",
    )


def dedup_lines(docs: DataFrame, width: int = WINDOW, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the covered lines taken out of ``text``; all columns are kept."""
    out = covered(docs, width).withColumnsRenamed({"id": "__covered_id", "lines": _COVERED})
    passed, maybe = bloom.split(docs, "doc_id", out)
    joined = maybe.join(out, F.col("doc_id") == F.col("__covered_id"), "left").drop("__covered_id")
    text_at = docs.columns.index("text")
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, j - i) for b in source for i, j in units.byte_slices(b.column(text_at))):
            gone = batch.column(batch.num_columns - 1)
            columns = batch.columns[:-1]
            rows = [i for i in range(len(batch)) if gone[i].is_valid]
            if rows:
                texts = columns[text_at].to_pylist()
                counts = columns[count_at].to_pylist() if count_at is not None else None
                for row in rows:
                    texts[row] = without(texts[row], set(gone[row].as_py()))
                    if counts:
                        counts[row] = len(texts[row])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if counts:
                    columns[count_at] = pa.array(counts, columns[count_at].type)
            edited = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
            if drop_emptied and rows:
                emptied = {row for row in rows if not texts[row]}
                edited = edited.filter(pa.array([i not in emptied for i in range(len(edited))]))
            yield edited

    kept = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return passed.unionByName(joined.mapInArrow(run, kept))


def without(text: str, gone: set[int]) -> str:
    """The lines whose numbers are not gone; nothing if only blank ones are left."""
    left = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
    return left if left.strip(" \t\r\x0b\f\n") else ""
