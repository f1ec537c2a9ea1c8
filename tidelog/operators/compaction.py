"""Compaction: a rewritten log that every snapshot kept still reads alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import DELETION, MERGE, VALUE
from tidelog.operators.ordered import running
from tidelog.operators.resolve import SUM, Merge, folded, resolve, uncovered

COLUMNS = ("user_key", "seq", "kind", "value")
#: Up to so many files of a level go to every task.
LISTED_FILES = 64


def compact(log: DataFrame, ranges: DataFrame, keep_from: int, merge: Merge = SUM, drop: Column | None = None, deeper: DataFrame | None = None) -> DataFrame:
    """The log after compaction; ``keep_from``: the smallest snapshot that must still be read.

    Newer records stay.  Older ones become one value a key.  ``drop``: a filter on
    user_key, seq and value; what it is true for goes.  ``deeper`` (user_key): keys with older
    records elsewhere; their deletions stay, dropped values leave a deletion, and merge records
    without a base stay as they are."""
    newer = log.where(F.col("seq") > keep_from).select(*COLUMNS)
    older = log.where(F.col("seq") <= keep_from)
    if deeper is None:
        view = resolve(older, ranges, keep_from, merge)
        if drop is not None:
            view = view.where(~drop)
        return newer.unionByName(view.withColumn("kind", F.lit(VALUE)).select(*COLUMNS))
    live = uncovered(older, ranges, keep_from)
    by_key = live.groupBy("user_key").agg(F.max(F.when(F.col("kind") != MERGE, F.col("seq"))).alias("base"))
    marked = live.join(by_key, "user_key").join(deeper.select("user_key", F.lit(True).alias("deep")).distinct(), "user_key", "left")
    marked = marked.where("base IS NULL OR seq >= base").withColumn("deep", F.coalesce("deep", F.lit(False)))
    open_end = F.col("base").isNull() & F.col("deep")
    passed = marked.where(open_end).select(*COLUMNS)
    kept = folded(marked.where(~open_end), merge, deep=F.col("deep"))
    gone = ~F.col("exists") if drop is None else ~F.col("exists") | drop
    kept = kept.where(~gone | F.col("deep")).withColumn("kind", F.when(gone, DELETION).otherwise(VALUE)).withColumn("value", F.when(~gone, F.col("value")))
    return newer.unionByName(passed).unionByName(kept.select(*COLUMNS))


def reasons(log: DataFrame, ranges: DataFrame, keep_from: int) -> DataFrame:
    """Each record and what a full compaction does to it: newer, ranged, covered, deletion, folded or kept."""
    live = uncovered(log.where(F.col("seq") <= keep_from), ranges, keep_from).select("user_key", "seq", F.lit(True).alias("live"))
    marked = log.join(live, ["user_key", "seq"], "left")
    counted = (F.col("seq") <= keep_from) & F.col("live")
    by_key = marked.where(counted).groupBy("user_key").agg(F.max(F.when(F.col("kind") != MERGE, F.col("seq"))).alias("base"), F.max("seq").alias("head"))
    reason = (
        F.when(F.col("seq") > keep_from, "newer").when(F.col("live").isNull(), "ranged").when(F.col("seq") < F.col("base"), "covered")
        .when(F.col("seq") < F.col("head"), "folded").when(F.col("kind") == DELETION, "deletion").otherwise("kept")
    )
    return marked.join(by_key, "user_key", "left").select("user_key", "seq", "kind", reason.alias("reason"))


def retired(ranges: DataFrame, log: DataFrame, keep_from: int) -> DataFrame:
    """The range deletions that may go: old enough, and no record left in their range.

    Keys are counted in order; a range holds one if the counts before its two ends differ."""
    old = ranges.where(F.col("rseq") <= keep_from)
    ends = old.select(F.col("start_key").alias("user_key")).unionAll(old.select("end_key")).distinct()
    every = log.select("user_key").distinct().select("user_key", F.lit(1).alias("is_key"), F.lit(1).alias("one"))
    before = running(every.unionAll(ends.select("user_key", F.lit(0).alias("is_key"), F.lit(0).alias("one"))), ["user_key", "is_key"], "one", "n").where("is_key = 0")
    side = lambda c, n: before.select(F.col("user_key").alias(c), F.col("n").alias(n))
    return old.join(side("start_key", "first"), "start_key").join(side("end_key", "last"), "end_key").where("last <= first").select(*ranges.columns)


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def overlapping(files: DataFrame, level: int, lower: str, upper: str) -> DataFrame:
    """Files of a level that have keys from ``lower`` to ``upper``, both included."""
    return files.where((F.col("level") == level) & (F.col("smallest") <= upper) & (F.col("largest") >= lower))


def find_file(files: DataFrame, keys: DataFrame, level: int) -> DataFrame:
    """Of sorted, disjoint files the one whose range has each key, or none.

    A level of few files goes to every task; beyond that keys and files are put in order by key range."""
    own = files.where(F.col("level") == level).select("num", "smallest", "largest")
    inside = (F.col("user_key") >= F.col("smallest")) & (F.col("user_key") <= F.col("largest"))
    if own.limit(LISTED_FILES + 1).count() <= LISTED_FILES:
        return keys.join(F.broadcast(own), inside, "left").select("user_key", "num")
    starts = own.select(F.col("smallest").alias("user_key"), F.lit(0).alias("is_key"), F.struct("num", "largest").alias("file"))
    asked = keys.select("user_key").distinct().select("user_key", F.lit(1).alias("is_key"), F.lit(None).cast(starts.schema["file"].dataType).alias("file"))
    found = running(starts.unionByName(asked), ["user_key", "is_key"], "file", "last", how="last").where("is_key = 1 AND user_key <= last.largest")
    return keys.join(found.select("user_key", "last.num"), "user_key", "left").select("user_key", "num")


def pick_l0(files: DataFrame, trigger: int = 4) -> DataFrame:
    """The level-0 files to compact, closed under overlap, and the level-1 files that they overlap.

    Empty below ``trigger`` files.  The oldest file is first; files that overlap the range so far
    join it until none does, so no older version stays above a newer one.  That range is found in one pass, however long the chain of
    files: ranges that are open are counted in the order of their ends, and none is where a chain ends."""
    zero = files.where("level = 0")
    seen = zero.agg(F.count("*").alias("n"), F.min_by(F.struct("smallest", "largest"), "num").alias("first")).first()
    if seen.n < trigger or seen.first is None:
        return files.limit(0)
    end = lambda c, is_end: F.struct(F.col(c).alias("at"), F.lit(is_end).alias("is_end"), "num", F.lit(1 - 2 * is_end).alias("step"))
    # at one key the starts come first: a file that ends where another starts overlaps it
    ends = zero.where("smallest <= largest").select(F.inline(F.array(end("smallest", 0), end("largest", 1))))
    opened = running(ends, ["at", "is_end", "num"], "step", "open")
    first = F.col("is_end") == 0, F.col("open") == 1, F.col("at") <= seen.first.smallest
    last = F.col("is_end") == 1, F.col("open") == 0, F.col("at") >= seen.first.largest
    when = lambda conditions: F.when(conditions[0] & conditions[1] & conditions[2], F.col("at"))
    lower, upper = opened.agg(F.max(when(first)), F.min(when(last))).first()
    return overlapping(zero, 0, lower, upper).unionByName(overlapping(files, 1, lower, upper))


def pick_by_size(files: DataFrame, base: int, multiplier: int = 10) -> DataFrame:
    """The leftmost file of the first level, from 1 on, that is over its capacity."""
    capacity = F.lit(base) * F.pow(F.lit(multiplier), F.col("level") - 1)
    over = level_stats(files).where((F.col("level") >= 1) & (F.col("bytes") > capacity)).agg(F.min("level").alias("level"))
    return files.join(F.broadcast(over), "level").orderBy("smallest", "num").limit(1)
