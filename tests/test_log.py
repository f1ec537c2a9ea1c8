"""The worked examples of the data model, and properties of compaction."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.model import LOG_SCHEMA, RANGE_SCHEMA, Conflict, InvalidScan, Mismatch, SnapshotReleased
from tidelog.operators import compaction, ordered, reads, writes
from tidelog.operators.resolve import APPEND, NONE, SUM, ordered_fold, resolve, strict

V, D, M = 1, 0, 2


def log_of(spark, *rows):
    return spark.createDataFrame([*rows], LOG_SCHEMA)


def ranges_of(spark, *rows):
    return spark.createDataFrame([*rows], RANGE_SCHEMA)


def shown(df):
    return {(r.user_key, r.seq): r.value for r in df.collect()}


def test_visibility(spark):
    log = log_of(spark, ("a", 10, V, 10), ("a", 5, V, 5), ("a", 1, V, 1), ("b", 9, D, None), ("b", 4, V, 4), ("c", 8, V, 8), ("c", 1, D, None))
    none = ranges_of(spark)
    expected = {100: {("a", 10): 10, ("c", 8): 8}, 6: {("a", 5): 5, ("b", 4): 4}, 1: {("a", 1): 1}, 0: {}}
    for s, view in expected.items():
        assert shown(resolve(log, none, s)) == view


def test_scans(spark):
    view = log_of(spark, *((k, 1, V, 1) for k in "abcd"))
    keys = lambda df: [r.user_key for r in df.orderBy("user_key").collect()]
    assert keys(reads.scan(view, "b", "c")) == ["b"]
    assert keys(reads.scan(view, "b")) == ["b", "c", "d"]
    assert keys(reads.seek(view, "d", upper="c")) == []
    assert keys(reads.seek(view, "a", lower="c")) == ["c"]
    assert reads.successor("a" + chr(0xD7FF)) == "a" + chr(0xE000)
    backwards = log_of(spark, *((k, 1, V, 1) for k in ("az", "by", "cx", "da")))
    assert keys(reads.scan(backwards, "cx", "az", order=F.reverse)) == ["by", "cx"] and keys(reads.seek(backwards, "xb", order=F.reverse)) == ["cx"]
    assert reads.successor("ab") == "ac" and reads.successor(chr(0x10FFFF)) is None
    with pytest.raises(InvalidScan):
        reads.scan(view, lower="a", prefix="b")


def test_range_deletion_is_per_record(spark):
    log = log_of(spark, *((k, i + 1, V, i) for i, k in enumerate("abcdefgh")), ("x", 9, V, 9), ("a", 11, D, None))
    rd = ranges_of(spark, ("c", "f", 10))
    assert sorted(k for k, _ in shown(resolve(log, rd))) == ["b", "f", "g", "h", "x"]
    assert len(shown(resolve(log, rd, 8))) == 8


def test_merges(spark):
    none = ranges_of(spark)
    log = log_of(spark, ("k", 1, M, 2), ("k", 2, M, 3), ("k", 3, D, None), ("k", 4, M, 7), ("k", 5, V, 100), ("k", 6, M, 1))
    assert [shown(resolve(log, none, s)).get(("k", s)) for s in range(1, 7)] == [2, 5, None, 7, 100, 101]
    assert shown(resolve(log, none, 2, APPEND)) == {("k", 2): "2,3"}
    covered = log_of(spark, ("k", 1, M, 2), ("k", 2, M, 3))
    assert shown(resolve(covered, ranges_of(spark, ("k", "l", 3)))) == {}


def test_many_range_deletions_take_the_other_way(spark, monkeypatch):
    from tidelog.operators import resolve as module

    for seed in range(3):
        rnd = random.Random(seed)
        rows = [(f"k{rnd.randrange(60):02}", i, V, i) for i in range(300)]
        ranges = [(f"k{a:02}", f"k{a + rnd.randrange(-1, 9):02}", rnd.randrange(300)) for a in range(50)] + [("k00", "k99", 20)]
        log, rd = log_of(spark, *rows), ranges_of(spark, *ranges)
        expected = sorted(r for r in rows if not any(a <= r[0] < b and r[1] < q for a, b, q in ranges))
        for listed in (1024, 3):
            monkeypatch.setattr(module, "LISTED_RANGES", listed)
            assert sorted(map(tuple, module.uncovered(log, rd).collect())) == expected
        old = sorted((a, b, q) for a, b, q in ranges if q <= 200 and not any(a <= k < b for k, *_ in rows[:40]))
        assert sorted(map(tuple, compaction.retired(rd, log_of(spark, *rows[:40]), 200).collect())) == old


def test_plans_of_many_range_deletions_hold_no_ranks(spark, monkeypatch):
    from tidelog.operators import resolve as module

    monkeypatch.setattr(module, "LISTED_RANGES", 2)
    log = log_of(spark, *(("k%02d" % (i % 40), i + 1, V, i) for i in range(80)))
    ranges = ranges_of(spark, *(("k%02d" % i, "k%02d" % (i + 2), 60) for i in range(0, 20, 2)))
    view = resolve(log, ranges)
    assert "Window" not in view._jdf.queryExecution().analyzed().toString()
    assert {r.user_key: r.value for r in view.collect()} == {"k%02d" % i: i + 40 for i in range(19, 40)}


@pytest.mark.parametrize("descending", [False, True])
def test_running_in_two_levels(spark, descending):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), i, rnd.randrange(5), rnd.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i long, n long, v long")
    turn = -1 if descending else 1
    for place in (None, F.expr("i div 7")):
        sums = ordered.running(df, ["i"], "n", "sum", partition=["g"], descending=descending, place=place)
        lasts = ordered.running(df, ["i"], "v", "last", descending=descending, how="last", place=place)
        for r in sums.collect():
            assert r["sum"] == sum(n for g, i, n, _ in rows if g == r.g and turn * i <= turn * r.i)
        for r in lasts.collect():
            seen = [v for _, i, _, v in sorted(rows, key=lambda x: turn * x[1]) if turn * i <= turn * r.i and v is not None]
            assert r["last"] == (seen[-1] if seen else None)
    assert ordered.running(df.limit(0), ["i"], "n", "sum").count() == 0


def test_files_in_order(spark, monkeypatch):
    files = spark.createDataFrame([(1, n, 1, f"k{9 * n:03}", f"k{9 * n + 5:03}") for n in range(20)], "level int, num long, size long, smallest string, largest string")
    keys = spark.createDataFrame([(f"k{i:03}",) for i in range(200)] * 2, "user_key string")
    few = sorted(map(repr, compaction.find_file(files, keys, 1).collect()))
    monkeypatch.setattr(compaction, "LISTED_FILES", 3)
    assert sorted(map(repr, compaction.find_file(files, keys, 1).collect())) == few


def test_hot_keys_and_runs(spark, monkeypatch):
    from tidelog.operators import resolve as module

    rows = [("hot", i, M if i % 7 else V, i) for i in range(1, 400)] + [(f"k{i}", 400 + i, V, i) for i in range(50)]
    log, none = log_of(spark, *rows), ranges_of(spark)
    halves = ordered_fold("halves", lambda a, x: a + F.floor(x["v"] / 2), F.lit(0).cast("long"), lambda a, b: a + b)
    expected = [shown(resolve(log, none, merge=m)) for m in (SUM, APPEND, halves)]
    assert expected[0]["hot", 399] == 399 and expected[1]["hot", 398 + 1] == "399"
    monkeypatch.setattr(module, "PART", 3)
    log = log_of(spark, *[r if r[2] == M or r[1] < 100 else (r[0], r[1], M, r[3]) for r in rows[:-50]], *rows[-50:])
    whole = {m.name: shown(resolve(log, none, merge=m))["hot", 399] for m in (SUM, APPEND, halves)}
    run = [i for i in range(98, 400)]
    assert whole == {"sum": sum(run), "append": ",".join(map(str, run)), "halves": sum(i // 2 for i in run)}


def test_operators_that_fail(spark):
    none, log = ranges_of(spark), log_of(spark, ("k", 1, V, 10), ("k", 2, M, -1))
    assert shown(resolve(log, none, 1, NONE)) == {("k", 1): 10}
    for merge in (NONE, strict("positive", SUM, lambda v: v > 0)):
        with pytest.raises(Exception, match="NoMergeOperator|positive: bad operand -1"):
            resolve(log, none, merge=merge).collect()
    assert shown(resolve(log, none, 1, strict("positive", SUM, lambda v: v > 0))) == {("k", 1): 10}
    writes.named_alike({"merge": None, "filter": "f"}, {"merge": "sum", "filter": "f"})
    for opened in ({"merge": "max"}, {}):
        with pytest.raises(Mismatch):
            writes.named_alike({"merge": "sum"}, opened)


def test_batches(spark):
    log, none = log_of(spark, ("a", 1, V, 1), ("c", 2, V, 2)), ranges_of(spark)
    batch = lambda *rows: spark.createDataFrame([*rows], writes.BATCH_SCHEMA)
    own = batch((30, "put", "x", 3, None), (10, "put", "x", 1, None), (20, "delete_range", "a", None, "d"), (40, "merge", "n", 5, None), (5, "delete", "gone", None, None))
    after, ranges = writes.write(log, none, own)
    assert shown(resolve(after, ranges)) == {("x", 6): 3, ("n", 7): 5}
    assert sorted((r.seq, r.kind) for r in after.collect()) == [(1, V), (2, V), (3, D), (4, V), (6, V), (7, M)] and ranges.collect()[0].rseq == 5
    for bad, error in (((1, "put", "", 1, None), "EmptyKey"), ((1, "delete_range", "b", None, "b"), "InvalidRange"), ((1, "delete_range", "b", None, None), "EmptyKey")):
        with pytest.raises(Exception, match=error):
            writes.numbered(batch(bad), 0).collect()
    with pytest.raises(Exception, match="NoMergeOperator"):
        writes.numbered(batch((1, "merge", "k", 1, None)), 0, merges=False).collect()
    empty, _ = writes.write(log, none, own.limit(0))
    assert empty.count() == 2


def test_checked_commits_and_snapshots(spark):
    log, none = log_of(spark, ("a", 1, V, 1), ("b", 2, V, 2)), ranges_of(spark)
    view = writes.snapshot(log, none)
    read = reads.get_for_update(view.view(), spark.createDataFrame([(0, "a"), (1, "z")], "idx long, user_key string")).select("user_key", "seq")
    mine = spark.createDataFrame([(1, "put", "a", 9, None)], writes.BATCH_SCHEMA)
    done, _ = writes.write_checked(log, none, mine, read)
    assert shown(resolve(done, none))["a", 3] == 9
    other = log.unionByName(log_of(spark, ("a", 3, V, 1)))  # the same bytes, another number
    with pytest.raises(Conflict):
        writes.write_checked(other, none, mine, read)
    allowed, _ = writes.write_checked(other, none, mine, read, check=lambda then, now: now <= 3)
    assert allowed.count() == 4 and writes.write_checked(other, none, mine.limit(0), read)[0].count() == 3
    later = writes.snapshot(other, none)
    later.release()
    assert writes.statistics(other, none, [view, later]).first() == (1, 0, 3)
    with pytest.raises(SnapshotReleased):
        later.view()


@pytest.mark.parametrize("seed", range(3))
def test_compaction_keeps_every_later_view(spark, seed):
    rnd = random.Random(seed)
    log = log_of(spark, *((rnd.choice("abcdef"), i, rnd.choice([D, V, M, M]), i) for i in range(1, 60))).withColumn("value", F.expr("CASE WHEN kind <> 0 THEN value END"))
    rd = ranges_of(spark, ("b", "d", 60 + 1), ("a", "c", 17), ("d", "f", 33))
    keep = rnd.randrange(10, 50)
    small = compaction.compact(log, rd, keep)
    for s in (keep, keep + 3, 59, 100):
        assert shown(resolve(small, rd, s)) == shown(resolve(log, rd, s))
    upper, lower = log.where("seq > 30"), log.where("seq <= 30")
    levelled = compaction.compact(upper, rd, 1000, deeper=lower).unionByName(lower)
    assert shown(resolve(levelled, rd)) == shown(resolve(log, rd))


def test_fold_rules(spark):
    none = ranges_of(spark)
    kept = lambda df: sorted((r.user_key, r.seq, r.kind, r.value) for r in df.collect())
    log = log_of(spark, ("k", 8, M, 100), ("k", 5, M, 4), ("k", 3, V, 10))
    assert kept(compaction.compact(log, none, 5)) == [("k", 5, V, 14), ("k", 8, M, 100)]
    deeper = spark.createDataFrame([("k",)], "user_key string")
    assert kept(compaction.compact(log_of(spark, ("k", 5, M, 4), ("k", 4, M, 3)), none, 5, deeper=deeper)) == [("k", 4, M, 3), ("k", 5, M, 4)]
    assert kept(compaction.compact(log_of(spark, ("k", 5, D, None)), none, 5, deeper=deeper)) == [("k", 5, D, None)]
    assert kept(compaction.compact(log_of(spark, ("k", 2, D, None), ("k", 1, V, 1)), none, 2)) == []
    dropped = compaction.compact(log_of(spark, ("k", 5, M, 4), ("k", 3, V, 10)), none, 5, drop=F.lit(True), deeper=deeper)
    assert kept(dropped) == [("k", 5, D, None)]


def test_level_zero_is_closed_under_overlap(spark):
    files = spark.createDataFrame([(0, 1, 1, "a", "c"), (0, 2, 1, "m", "z"), (0, 3, 1, "b", "p")], "level int, num long, size long, smallest string, largest string")
    assert sorted(r.num for r in compaction.pick_l0(files, 2).collect()) == [1, 2, 3]
    assert compaction.pick_l0(files, 4).count() == 0


def test_level_zero_of_a_long_chain_takes_one_pass(spark):
    rows = lambda n: [(0, n - i, 1, f"k{3 * i:05d}", f"k{3 * i + 3:05d}") for i in range(n)] + [(0, n + 1, 1, f"k{3 * n + 1:05d}", "k99999"), (1, 900, 1, "k00001", "k00002"), (1, 901, 1, f"k{3 * n:05d}", "k90000")]
    counts = []
    for n in (5, 40):
        files = spark.createDataFrame(rows(n), "level int, num long, size long, smallest string, largest string")
        spark.sparkContext.setJobGroup("chain", "")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
        assert sorted(r.num for r in compaction.pick_l0(files, 2).collect()) == [*range(1, n + 1), 900, 901]
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) - before)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] < counts[0] + 10


def test_requests_are_numbered_once(spark):
    from tidelog.plans import workload

    asked = workload.requests(spark, "/root/testdata/sf0.001", "d")
    assert "Window" not in asked._jdf.queryExecution().analyzed().toString() and asked.where("op = 'insert'").count() > 0


def test_varints_of_seven_bytes_and_more(spark):
    sizes = spark.createDataFrame([(x,) for x in (0, 127, 128, 2**35 - 1, 2**35, 2**42 - 1, 2**42, 2**49, 2**62)], "x long").select(codec.uvarint_length(F.col("x")).alias("n"))
    assert [r.n for r in sizes.collect()] == [1, 1, 2, 5, 6, 6, 7, 8, 9]


def test_stream_of_requests(spark, tmp_path):
    from tidelog.streaming import ingest

    source = tmp_path / "in"
    for i, rows in enumerate(([(1, "put", "a", 1, None), (2, "merge", "a", 2, None)], [(1, "delete_range", "a", None, "b"), (2, "put", "c", 3, None)])):
        spark.createDataFrame(rows, writes.BATCH_SCHEMA).coalesce(1).write.parquet(str(source / f"part={i}"))
        requests = spark.readStream.schema(writes.BATCH_SCHEMA + ", part int").parquet(str(source)).drop("part")
        for _ in range(2):  # begun again it finds nothing new
            ingest.ingest(requests, str(tmp_path / "log"), str(tmp_path / "progress")).awaitTermination()
        log, ranges = ingest.log_of(spark, str(tmp_path / "log"))
        assert shown(resolve(log, ranges)) == ({("a", 2): 3}, {("c", 4): 3})[i]


def test_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__ as entry
    from tidelog.plans import queries

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("events", "orders", "lineitem", "customer", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    assert set(queries.QUERIES) <= set(entry.queries())
    for name in ("latest_view", "merge_append", "compact_levelled", "find_file", "ycsb_d", "ycsb_e", "pick_l0", "uvarint_bytes", "write_batch_view", "checked_commit", "latency_nearest_rank"):
        df = queries.QUERIES[name](spark, d)
        columns = ", ".join(sorted(df.columns))
        own = sorted(map(repr, map(tuple, df.selectExpr(*sorted(df.columns)).collect())))
        assert own == sorted(map(repr, con.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall())), name
