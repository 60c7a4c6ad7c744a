"""Column expressions over arrays of any length that take linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a running sum taken at once.
CHUNK = 128


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed a single time, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of whole numbers, ``op`` over those before it, from 0 on. Chunks are taken
    one by one, each from where the last one ended, so time is linear for any length in use."""

    def chunked(held: Column) -> Column:
        last = F.floor((F.size(held) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(held, k * CHUNK + 1, CHUNK))

    def grown(start: Column, part: Column) -> Column:
        whole = F.aggregate(part, F.array(start), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v))))
        return once(whole, lambda w: F.slice(w, 1, F.size(w) - 1))

    def joined(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), op))
        return F.flatten(F.zip_with(chunks, grown(F.lit(0), totals), lambda c, start: grown(start, c)))

    return once(once(values, chunked), joined)
