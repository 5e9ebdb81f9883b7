"""Keep rows that cannot be in a small set out of a join: a blocked Bloom filter as a table.

The filter has one row for each 64-bit word with a bit set, two bits for each key. It is broadcast;
its words grow with the keys up to ``MAX_WORDS``, the bound of what is broadcast (16 bytes a word).
Beyond it more rows take part in the join than need be, and results do not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS = 1 << 22
_WORD, _BITS, _MAYBE = "__bloom_word", "__bloom_bits", "__bloom_maybe"


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words).cast("long"))


def _mask(key: Column) -> Column:
    second = F.xxhash64(key, F.lit(1))
    one = F.pmod(second, F.lit(64)).cast("int")
    two = F.pmod(F.shiftright(second, 6), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), one).bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), two)
    )


def split(rows: DataFrame, key: str, members: DataFrame, max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` is surely not in the first column of ``members``, and all others.

    ``members`` should be a stored table, as it is counted. Keys have to be of the same type; a null
    key is surely not in it.
    """
    words = max(1024, min(max_words, 2 * members.count()))
    own = F.col(members.columns[0])
    filled = members.select(_word(own, words).alias(_WORD), _mask(own).alias("mask"))
    filled = filled.groupBy(_WORD).agg(F.bit_or("mask").alias(_BITS))
    mask = _mask(F.col(key))
    tested = (
        rows.withColumn(_WORD, _word(F.col(key), words))
        .join(F.broadcast(filled), _WORD, "left")
        .withColumn(_MAYBE, F.col(key).isNotNull() & F.coalesce(F.col(_BITS).bitwiseAND(mask) == mask, F.lit(False)))
    )
    return tested.where(~F.col(_MAYBE)).select(*rows.columns), tested.where(_MAYBE).select(*rows.columns)
