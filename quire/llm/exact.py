"""Exact de-duplication after white space is taken out, by two passes over a Bloom filter.

The first pass puts every text's hash into a blocked Bloom filter (one 64-bit word, two bits of it)
and keeps only bits that were set at least twice. The second tests every row against these words:
a row whose two bits were not both repeated is alone and passes straight through; only the others
are shuffled by their full digest. Built from DataFrame functions only; texts are never shuffled.

The filter grows with the rows up to ``max_words`` 64-bit words, the bound of what is broadcast
(16 bytes a word and less, as words without a repeated bit are left out). Beyond that bound more rows
are shuffled than need be; results do not change.

A null text is empty. Every row gives one row. Of rows with equal texts and lengths the smallest
``doc_id`` stays, null last; repeated rows with that ``doc_id`` all stay. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import store

MAX_WORDS = 1 << 22
SPACES = r"[\x20\x09-\x0D]+"


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_points, digest``: length in code points and SHA-256 of the text without spaces."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(text, SPACES, "")
    return docs.select(
        "doc_id",
        F.char_length(text).cast("long").alias("n_points"),
        F.unhex(F.sha2(F.encode(bare, "UTF-8"), 256)).alias("digest"),
    )


def _cells(prints: DataFrame, words: int) -> DataFrame:
    """The filter word of each digest and its two bits."""
    second = F.xxhash64(F.col("digest"), F.lit(1))
    return prints.withColumns(
        {
            "word": F.pmod(F.xxhash64("digest"), F.lit(words).cast("long")),
            "bit_a": F.pmod(second, F.lit(64)).cast("int"),
            "bit_b": F.pmod(F.shiftright(second, 6), F.lit(64)).cast("int"),
        }
    )


def repeated_words(prints: DataFrame, words: int) -> DataFrame:
    """First pass: ``word, bits``, the bits of the filter that more than one row has set."""
    cells = _cells(prints, words).select("word", F.explode(F.array_distinct(F.array("bit_a", "bit_b"))).alias("bit"))
    return (
        cells.groupBy("word", "bit").agg(F.count("*").alias("n")).where("n > 1")
        .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    )


def mark(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``doc_id, text``."""
    prints = store(fingerprints(docs), "prints")
    words = max(1024, min(max_words, prints.count()))
    seen = repeated_words(prints, words)
    mask = F.expr("shiftleft(1L, bit_a) | shiftleft(1L, bit_b)")
    tested = _cells(prints, words).join(F.broadcast(seen), "word", "left").select(
        "doc_id", "n_points", "digest",
        F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False)).alias("maybe"),
    )
    alone = tested.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    maybe = tested.where("maybe").drop("maybe")
    order = F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    groups = store(
        maybe.groupBy("digest").agg(F.min(order)["id"].alias("keep_id"), F.count("*").alias("group_size")), "groups"
    )
    met = maybe.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return alone.unionByName(met)


def dedup(docs: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; ``doc_id`` has to be unique here."""
    gone = mark(docs, max_words).where("NOT kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
