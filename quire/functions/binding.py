"""Small building blocks shared by the column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand the result to ``body``.

    A column referenced inside a lambda is recomputed for every element unless
    it is itself a lambda variable, so anything expensive goes through here.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def runs_of(sorted_items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Start and length of every run of equal neighbours, as (at, n), linear time."""

    def starts(items: Column) -> Column:
        index = F.sequence(F.lit(0), F.size(items) - 1)
        firsts = F.filter(
            index,
            lambda i: (i == 0) | ~same(F.get(items, i), F.get(items, i - 1)),
        )
        return bind(
            firsts,
            lambda at: F.transform(
                at,
                lambda b, j: F.struct(
                    b.alias("at"),
                    (F.coalesce(F.get(at, j + 1), F.size(items)) - b).alias("n"),
                ),
            ),
        )

    none = F.expr("cast(array() AS array<struct<at:int,n:int>>)")
    return F.when(F.size(sorted_items) > 0, starts(sorted_items)).otherwise(none)
