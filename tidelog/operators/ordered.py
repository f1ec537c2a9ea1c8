"""Running aggregates over a whole table in order, in two levels: within key ranges, then over the ranges.

No task gets the whole table: rows are dealt by range of their order, each range is summed up, and the small table
of one row a range carries the sums on."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key ranges of a table.
PLACES = 256


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def searched(value: Column, cuts: list, listed: Callable[[list], Column]) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``: a search in two steps of about sqrt(len(cuts)).

    ``listed``: the array of some cuts."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts) - 1) + 1
    before = lambda found, v: F.size(F.filter(found, lambda x: x <= v))
    inside = lambda v, group: group * step + before(F.slice(listed(cuts), group * step + 1, step), v)
    return _bound(value, lambda v: _bound(before(listed(cuts[step - 1 :: step]), v), lambda group: inside(v, group)))


def place_of(df: DataFrame, order: Sequence[str], places: int = PLACES) -> Column:
    """The key range of a row; cuts are the order values of the smallest digests, ``places`` - 1 at most."""
    kinds = {c: df.schema[c].dataType for c in order}
    seen = df.select(*order).distinct().orderBy(F.xxhash64(*order), *order).limit(places - 1).collect()
    literal = lambda row: F.struct(*(F.lit(row[c]).cast(kinds[c]).alias(c) for c in order))
    return searched(F.struct(*order), sorted(seen, key=tuple), lambda rows: F.array(*map(literal, rows)))


def running(
    df: DataFrame, order: Sequence[str], value: str, name: str, partition: Sequence[str] = (), descending: bool = False, how: str = "sum",
    place: Column | None = None, more: dict[str, str] | None = None,
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows up to and with each row, or (``how`` = last) the last that is not null.

    ``order`` identifies a row within ``partition`` and has no nulls; with ``partition``, each of its groups runs by itself.
    ``place``: a key range that follows the order, where one is known.  ``more``: further names and values."""
    values = {name: value, **(more or {})}
    dealt = df.withColumn("place", place_of(df, [*partition, *order]) if place is None else place)
    turn = F.desc if descending else F.asc
    inside = Window.partitionBy("place", *partition).orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*partition).orderBy(turn("place")).rowsBetween(Window.unboundedPreceding, -1)
    if how == "sum":
        total = aggregate = F.sum
        both = lambda k: F.coalesce(F.col(f"own_{k}"), F.lit(0)) + F.coalesce(F.col(f"carried_{k}"), F.lit(0))
    else:
        pick = F.min_by if descending else F.max_by
        total, aggregate = lambda c: pick(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))), lambda c: F.last(c, True)
        both = lambda k: F.coalesce(f"own_{k}", f"carried_{k}")
    carried = dealt.groupBy("place", *partition).agg(*(total(c).alias(f"total_{k}") for k, c in values.items()))
    carried = carried.select("place", *partition, *(aggregate(f"total_{k}").over(over).alias(f"carried_{k}") for k in values))
    summed = dealt.select("*", *(aggregate(c).over(inside).alias(f"own_{k}") for k, c in values.items())).join(carried, ["place", *partition])
    return summed.select(*df.columns, *(both(k).alias(k) for k in values))
