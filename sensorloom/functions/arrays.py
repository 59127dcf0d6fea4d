"""Column functions over arrays of doubles. Empty arrays give null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

NONE = "array<double>"


def present(a: Column) -> Column:
    """The values that are there; no array is an empty one."""
    return F.coalesce(F.filter(a, lambda x: x.isNotNull()), F.array().cast(NONE))


def total(a: Column, use: Callable[[Column], Column] = lambda x: x) -> Column:
    """The sum of use(value) over the values."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + use(x))


def mean(a: Column, use: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.try_divide(total(a, use), F.size(a))


def deviation(a: Column) -> Column:
    """The population deviation; exactly 0 where all values are equal."""
    return let(F.get(a, F.lit(0)), lambda first: let(first + mean(a, lambda x: x - first), lambda m: F.sqrt(mean(a, lambda x: (x - m) * (x - m)))))


def quantile(ordered: Column, p: float) -> Column:
    """The linear percentile of sorted values."""
    place = (F.size(ordered) - 1) * F.lit(p)

    def between(x: Column) -> Column:
        low, high = F.floor(x).cast("int"), F.ceil(x).cast("int")
        return F.when(low == high, F.get(ordered, low)).otherwise((high - x) * F.get(ordered, low) + (x - low) * F.get(ordered, high))

    return let(place, between)


def laid(pieces: Column, start: Column) -> Column:
    """One array from sorted pieces (i, place of the first value; v, values), with nulls from start on where there is none. Of pieces at one place the last counts."""
    none = F.lit(None).cast("double")
    kept = F.filter(pieces, lambda s, j: F.coalesce(F.get(pieces, j + 1)["i"] > s["i"], F.lit(True)))

    def lay(kept: Column) -> Column:
        before = lambda p: F.coalesce(p["i"] + F.size(p["v"]), start)
        return F.flatten(F.transform(kept, lambda s, j: F.concat(F.array_repeat(none, (s["i"] - before(F.get(kept, j - 1))).cast("int")), s["v"])))

    return let(kept, lay)
