"""What a change log says at a snapshot.

Of the records up to snapshot S that no later range deletion covers, a key's newest value or
deletion is its base; newer merge records are folded onto it.  A key exists if its
base is a value or it has a merge record.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import DELETION, MERGE, VALUE, NoMergeOperator
from tidelog.operators.ordered import running, searched
from tidelog.sources.tables import written

#: Up to so many range deletions become a list of cuts in the plan; more are joined as a tree of key ranges.
LISTED_RANGES = 1024
#: Numbers of a key's records that are folded into one part first, where the fold is not a plain aggregate.
PART = 4096
#: Places of a key that has more than a thousandth of all records.
SALT = 64


@dataclass(frozen=True)
class Merge:
    """A fold: from (seq, kind, value) of a key's base and operands to its value.

    ``fold`` is an aggregate; rows that are deletions have a null value.  Where ``join`` is given, ``fold`` is used on runs of
    numbers first, and ``join`` is the aggregate of (run, part) that puts the parts together."""

    name: str
    fold: Callable[[Column, Column, Column], Column]
    join: Callable[[Column, Column], Column] | None = None


def _listed(order: Column, value: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("s"), value.alias("v")))))


def _text(order: Column, value: Column) -> Column:
    return F.when(F.count(value) > 0, F.concat_ws(",", F.transform(_listed(order, value), lambda x: x["v"].cast("string"))))


def _refused(seq: Column, kind: Column, value: Column) -> Column:
    return F.max_by(F.when(kind == MERGE, F.raise_error(F.lit(NoMergeOperator.__name__)).cast("long")).otherwise(value), seq)


SUM = Merge("sum", lambda seq, kind, value: F.sum(value))
MAX = Merge("max", lambda seq, kind, value: F.max(value))
MIN = Merge("min", lambda seq, kind, value: F.min(value))
APPEND = Merge("append", lambda seq, kind, value: _text(seq, value), _text)
#: Of a log without merge records; fails where one is met.
NONE = Merge("none", _refused)


def ordered_fold(name: str, step: Callable[[Column, Column], Column], start: Column, combine: Callable[[Column, Column], Column] | None = None) -> Merge:
    """Any fold by a function of columns, oldest record first.

    ``combine`` puts the results of an older and a newer run of records together; without it a key's records meet in one row,
    which suits keys of few records only."""
    chain = lambda seq, kind, value: F.array_sort(F.collect_list(F.when(kind != DELETION, F.struct(seq.alias("s"), kind.alias("k"), value.alias("v")))))
    join = None if combine is None else lambda run, part: F.aggregate(_listed(run, part), start, lambda a, x: combine(a, x["v"]))
    return Merge(name, lambda seq, kind, value: F.aggregate(chain(seq, kind, value), start, step), join)


def strict(name: str, merge: Merge, valid: Callable[[Column], Column]) -> Merge:
    """``merge`` that fails, as the query runs, on an operand that is not ``valid``."""
    checked = lambda kind, value: F.when((kind != MERGE) | valid(value), value).otherwise(F.raise_error(F.concat(F.lit(f"{name}: bad operand "), value.cast("string"))).cast("long"))
    return Merge(name, lambda seq, kind, value: merge.fold(seq, kind, checked(kind, value)), merge.join)


def _steps(rows: list) -> tuple[list, list]:
    """Ascending keys, and for the stretch from each to the next the greatest number of the ranges over it (or None)."""
    rows = [r for r in rows if r["start_key"] < r["end_key"]]
    keys = sorted({k for r in rows for k in (r["start_key"], r["end_key"])})
    return keys, [max((r["rseq"] for r in rows if r["start_key"] <= k < r["end_key"]), default=None) for k in keys]


def _blocks(first: str, last: str, levels: int) -> str:
    """SQL for the blocks (level, at) of a binary tree that make up the places from ``first`` up to ``last``."""
    take = lambda end, at: f"CASE WHEN s.l < s.r AND s.{end} % 2 = 1 THEN array(named_struct('level', i, 'at', {at})) ELSE cast(array() as array<struct<level:int,at:bigint>>) END"
    step = f"named_struct('l', (s.l + 1) div 2, 'r', s.r div 2, 'out', concat(s.out, {take('l', 's.l')}, {take('r', 's.r - 1')}))"
    # once both ends meet nothing is taken any more
    done = f"CASE WHEN s.l < s.r THEN {step} ELSE s END"
    start = f"named_struct('l', cast({first} as bigint), 'r', cast({last} as bigint), 'out', cast(array() as array<struct<level:int,at:bigint>>))"
    return f"aggregate(sequence(0, {levels}), {start}, (s, i) -> {done}, s -> s.out)"


def newest_cover(keys: DataFrame, ranges: DataFrame, levels: int) -> DataFrame:
    """user_key, rseq: for each key in a range the greatest number of the ranges that hold it.

    Range ends are ranked.  A range is the few blocks of a binary tree over the ranks that make it up, a key asks for the
    blocks around it, one a level: joins on equal values only, however ranges overlap.  Each step is written to the shared
    folder: as one plan it holds the log and the cuts of the ranks many times over."""
    ranges = ranges.where("start_key < end_key")
    ends = ranges.select(F.col("start_key").alias("user_key")).unionAll(ranges.select("end_key")).distinct().select("user_key", F.lit(0).alias("is_key"), F.lit(1).alias("one"))
    every = written(keys.select("user_key", F.lit(1).alias("is_key"), F.lit(0).alias("one")).unionAll(ends), "ends")
    ranked = written(running(every, ["user_key", "is_key"], "one", "upto"), "ranks")
    place = ranked.where("is_key = 0").select("user_key", (F.col("upto") - 1).alias("at"))
    side = lambda c, to: place.select(F.col("user_key").alias(c), F.col("at").alias(to))
    placed = ranges.join(side("start_key", "first"), "start_key").join(side("end_key", "last"), "end_key")
    tree = placed.select("rseq", F.expr(f"explode({_blocks('first', 'last', levels)})").alias("b")).groupBy("b.level", "b.at").agg(F.max("rseq").alias("rseq"))
    asked = ranked.where("is_key = 1 AND upto > 0").select("user_key", F.expr(f"explode(transform(sequence(0, {levels}), i -> named_struct('level', i, 'at', shiftright(upto - 1, i))))").alias("b"))
    # merged: the size of what is read from compressed files and exploded is guessed far too low for a broadcast
    return written(asked.select("user_key", "b.level", "b.at").join(tree.hint("merge"), ["level", "at"]).groupBy("user_key").agg(F.max("rseq").alias("rseq")), "covers")


def with_cover(log: DataFrame, ranges: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Adds cover: the number of the newest range deletion over a record's key, or null."""
    if snapshot is not None:
        log, ranges = log.where(F.col("seq") <= snapshot), ranges.where(F.col("rseq") <= snapshot)
    few = ranges.select("start_key", "end_key", "rseq").limit(LISTED_RANGES + 1).collect()
    if len(few) <= LISTED_RANGES:
        keys, newest = _steps(few)
        if not keys:
            return log.withColumn("cover", F.lit(None).cast("long"))
        # one literal each: a plan holds them several times
        at = searched(F.col("user_key"), keys, lambda some: F.from_json(F.lit(json.dumps(some)), "array<string>"))
        return log.withColumn("cover", F.get(F.from_json(F.lit(json.dumps(newest)), "array<bigint>"), at - 1))
    levels = (2 * ranges.count()).bit_length()
    covers = newest_cover(log.select("user_key").distinct(), ranges, levels)
    return log.join(covers.withColumnRenamed("rseq", "cover").hint("merge"), "user_key", "left")


def uncovered(log: DataFrame, ranges: DataFrame, snapshot: int | None = None) -> DataFrame:
    """The records that no range deletion up to the snapshot covers."""
    return with_cover(log, ranges, snapshot).where("coalesce(seq >= cover, true)").select(*log.columns)


def chains(live: DataFrame) -> DataFrame:
    """Of uncovered records each key's base and the merge records after it.

    The base's number is a partial aggregate.  The records of a key with more than a thousandth of all (so of a thousand keys at most,
    which are broadcast) meet their base in ``SALT`` places."""
    base = live.groupBy("user_key").agg(F.max(F.when(F.col("kind") != MERGE, F.col("seq"))).alias("base"), F.count("*").alias("n"))
    hot = base.where(F.col("n") > F.greatest(base.agg(F.sum("n")).scalar() / 1000, F.lit(1_000_000)))
    places = F.broadcast(hot.select("user_key", F.lit(SALT).alias("salts")))
    salted = live.join(places, "user_key", "left").withColumn("salt", F.pmod("seq", F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    bases = base.join(places, "user_key", "left").select("user_key", "base", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)")).alias("salt"))
    return salted.join(bases, ["user_key", "salt"]).where("base IS NULL OR seq >= base").drop("salt")


def folded(chain: DataFrame, merge: Merge, **more: Column) -> DataFrame:
    """user_key, seq (of the newest record), value, exists, and the maxima of ``more``, of each key of a chain."""
    value = F.when(F.col("kind") != DELETION, F.col("value"))
    rest = {"exists": F.col("kind").isin(VALUE, MERGE), **more}
    # numbers of one run, so that no row holds more than PART records
    by = ["user_key"] if merge.join is None else ["user_key", F.expr(f"seq div {PART}").alias("run")]
    parts = chain.groupBy(*by).agg(F.max("seq").alias("seq"), merge.fold(F.col("seq"), F.col("kind"), value).alias("value"), *(F.max(c).alias(k) for k, c in rest.items()))
    if merge.join is None:
        return parts
    return parts.groupBy("user_key").agg(F.max("seq").alias("seq"), merge.join(F.col("run"), F.col("value")).alias("value"), *(F.max(k).alias(k) for k in rest))


def resolve(log: DataFrame, ranges: DataFrame, snapshot: int | None = None, merge: Merge = SUM) -> DataFrame:
    """user_key, seq (of the newest record), value: the keys that exist at the snapshot."""
    return folded(chains(uncovered(log, ranges, snapshot)), merge).where("exists").drop("exists")
