"""Writes as DataFrames: records with dense numbers, appended to a log after their checks.

A batch is a table of requests (at, op, user_key, value, end_key): ``at`` is a request's place, op one of put, delete,
merge and delete_range.  Numbers follow the newest of the log without a gap, in the order of the batch, so that the later of two
writes to a key wins.  A bad request fails the query that reads the batch, before anything is written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import DELETION, MERGE, RANGE_DELETION, VALUE, Conflict, EmptyKey, InvalidRange, Mismatch, NoMergeOperator, SnapshotReleased
from tidelog.operators.ordered import running
from tidelog.operators.resolve import Merge, resolve

BATCH_SCHEMA = "at long, op string, user_key string, value long, end_key string"
KINDS = {"put": VALUE, "delete": DELETION, "merge": MERGE, "delete_range": RANGE_DELETION}


def error_of(merges: bool = True) -> Column:
    """The name of what is wrong with a request, or null; ``merges``: whether there is a merge operator."""
    empty = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    ranged = F.col("op") == "delete_range"
    return (
        F.when(empty("user_key") | ranged & empty("end_key"), EmptyKey.__name__)
        .when(ranged & (F.col("end_key") <= F.col("user_key")), InvalidRange.__name__)
        .when((F.col("op") == "merge") & F.lit(not merges), NoMergeOperator.__name__)
        .when(~F.col("op").isin(*KINDS), F.concat(F.lit("unknown: "), "op"))
    )


def last_seq(log: DataFrame, ranges: DataFrame) -> int:
    newest = log.select("seq").unionAll(ranges.select("rseq")).agg(F.max("seq")).first()[0]
    return newest or 0


def numbered(batch: DataFrame, after: int, merges: bool = True) -> DataFrame:
    """user_key, seq, kind, value, end_key of a batch; ``after``: the log's newest number."""
    wrong = error_of(merges)
    checked = batch.withColumn("op", F.when(wrong.isNull(), F.col("op")).otherwise(F.raise_error(wrong)))
    kind = F.coalesce(*(F.when(F.col("op") == k, v) for k, v in KINDS.items()))
    placed = running(checked.withColumn("one", F.lit(1)), ["at"], "one", "i")
    value = F.when(F.col("op").isin("put", "merge"), F.col("value"))
    return placed.select("user_key", (F.col("i") + after).alias("seq"), kind.alias("kind"), value.alias("value"), "end_key")


def appended(log: DataFrame, ranges: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log and ranges with the records of a batch."""
    points = records.where(F.col("kind") != RANGE_DELETION).select(*log.columns)
    more = records.where(F.col("kind") == RANGE_DELETION).select(F.col("user_key").alias("start_key"), "end_key", F.col("seq").alias("rseq"))
    return log.unionByName(points), ranges.unionByName(more)


def write(log: DataFrame, ranges: DataFrame, batch: DataFrame, merges: bool = True) -> tuple[DataFrame, DataFrame]:
    return appended(log, ranges, numbered(batch, last_seq(log, ranges), merges))


def checked(view: DataFrame, reads: DataFrame, check: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Of ``reads`` (user_key, seq read; 0: it was missing) those whose check fails now.

    ``check``: from the number read and the newest number of the key (0: missing) to whether the commit may go on; by default they are equal.
    Numbers differ also where a value was written again with the same bytes."""
    check = check or (lambda then, now: then == now)
    both = reads.join(view.select("user_key", F.col("seq").alias("now")), "user_key", "left").withColumn("now", F.coalesce("now", F.lit(0)))
    return both.where(~F.coalesce(check(F.col("seq"), F.col("now")), F.lit(False)))


def write_checked(log: DataFrame, ranges: DataFrame, batch: DataFrame, reads: DataFrame, check: Callable[[Column, Column], Column] | None = None, merge: Merge | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``write``, if what was read still stands; else nothing is written and ``Conflict`` is raised.  An empty batch skips the check."""
    if batch.isEmpty():
        return log, ranges
    view = resolve(log, ranges, merge=merge) if merge else resolve(log, ranges)
    if not checked(view, reads, check).isEmpty():
        raise Conflict
    return write(log, ranges, batch)


@dataclass
class Snapshot:
    """A fixed view of a log; not to be read after its release."""

    log: DataFrame
    ranges: DataFrame
    seq: int
    released: bool = False

    def view(self, **options) -> DataFrame:
        if self.released:
            raise SnapshotReleased
        return resolve(self.log, self.ranges, self.seq, **options)

    def release(self) -> None:
        self.released = True


def snapshot(log: DataFrame, ranges: DataFrame) -> Snapshot:
    return Snapshot(log, ranges, last_seq(log, ranges))


def statistics(log: DataFrame, ranges: DataFrame, snapshots: list[Snapshot]) -> DataFrame:
    """One row: snapshots not released, range deletions, and the newest number."""
    live = sum(not s.released for s in snapshots)
    parts = log.agg(F.max("seq").alias("last"), F.lit(0).alias("n")).unionAll(ranges.agg(F.max("rseq"), F.count("*")))
    return parts.agg(F.lit(live).cast("long").alias("live_snapshots"), F.sum("n").alias("range_deletions"), F.max("last").alias("last_seq"))


def named_alike(made_with: dict[str, str | None], opened_with: dict[str, str | None]) -> None:
    """Refuses a log whose merge operator, filter or order has another name, or none, than when it was made.

    An operator may be added to a log that was made without one."""
    for what, own in made_with.items():
        if own is not None and opened_with.get(what) != own:
            raise Mismatch(f"{what}: {own!r} then, {opened_with.get(what)!r} now")
