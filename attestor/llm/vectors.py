"""Embedding vectors as exact integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = float("inf")


def whole(vector: Column) -> Column:
    """Whether a vector is there and each of its entries is there and finite."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INFINITE)), F.lit(False))


def scaled(vector: Column, factor: int, limit: int, shift: int = 0) -> Column:
    """floor(factor * c) + shift of each entry c, taken as double. An entry whose floor is not between -limit and limit ends
    the query with an error: beyond it sums and squares would leave the range of a long unseen."""

    def entry(c: Column) -> Column:
        x = F.floor(c.cast("double") * factor)
        wrong = F.raise_error(F.concat(F.lit(f"a vector entry is beyond {limit}/{factor}: "), c.cast("string"))).cast("long")
        return F.when(F.abs(c.cast("double") * factor) < limit, x + F.lit(shift).cast("long")).otherwise(wrong)

    return F.transform(vector, entry)
