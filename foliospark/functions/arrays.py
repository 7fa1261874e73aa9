"""Array functions that the built-in ones lack: a value bound once, and running totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a running total takes at a time.
BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element of an array<int> the merged elements before it.

    Within blocks, and over the blocks' totals: an array that grows by one element is copied each time, so that one fold over
    all elements would be quadratic.
    """

    def inside(part: Column, first: Column) -> Column:
        state = F.struct(first.alias("now"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, state, lambda a, v: F.struct(merge(a.now, v).alias("now"), F.array_append(a.out, a.now).alias("out")), lambda a: a.out)

    def whole(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / BLOCK).cast("int"), F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        return bound(blocks, lambda b: F.flatten(F.zip_with(b, inside(F.transform(b, lambda p: F.aggregate(p, zero, merge)), zero), inside)))

    return bound(values, whole)
