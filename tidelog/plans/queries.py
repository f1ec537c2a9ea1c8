"""The registered queries over change logs, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import codec
from tidelog.operators import compaction, reads, writes
from tidelog.operators.resolve import APPEND, MAX, MIN, SUM, chains, ordered_fold, resolve, uncovered
from tidelog.operators.ordered import running
from tidelog.plans import workload
from tidelog.sources import tables
from tidelog.sources.derived import event_log, key_of, order_files
from tidelog.streaming import ingest as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Snapshots, as parts of the newest number of the log.
QUARTER, THIRD, HALF = 4, 3, 2

LOG = """ev AS (SELECT event_id + 1 AS seq, printf('user%012d', user_id) AS user_key, CASE WHEN event_id % 1000 = 500 THEN 3
  WHEN event_type IN ('signup', 'view') THEN 1 WHEN event_type = 'error' THEN 0 ELSE 2 END AS kind,
  CAST(round(value * 100) AS BIGINT) AS value, printf('user%012d', user_id + 5) AS end_key FROM events),
log AS (SELECT user_key, seq, kind, value FROM ev WHERE kind <> 3),
rd AS (SELECT user_key AS start_key, end_key, seq AS rseq FROM ev WHERE kind = 3)"""


def at(spark, d, part: int) -> int:
    """The snapshot at a part of the log's numbers."""
    return (spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id")).first()[0] + 1) // part


def at_sql(part: int) -> str:
    return f"(SELECT (max(event_id) + 1) // {part} FROM events)"


def live_sql(s: str, name: str = "live", log: str = "log") -> str:
    return f"""{name} AS (SELECT * FROM {log} o WHERE seq <= {s} AND NOT EXISTS (SELECT 1 FROM rd r WHERE r.rseq <= {s}
  AND o.user_key >= r.start_key AND o.user_key < r.end_key AND o.seq < r.rseq))"""


def view_sql(s: str = "1000000000", fold: str = "CAST(sum(CASE WHEN kind <> 0 THEN value END) AS BIGINT)", name: str = "view_", log: str = "log") -> str:
    return f"""{live_sql(s, 'live' + name, log)},
t{name} AS (SELECT *, max(CASE WHEN kind <> 2 THEN seq END) OVER (PARTITION BY user_key) AS base FROM live{name}),
{name} AS (SELECT user_key, max(seq) AS seq, {fold} AS value FROM t{name} WHERE base IS NULL OR seq >= base GROUP BY user_key HAVING max(CASE WHEN kind <> 0 THEN 1 ELSE 0 END) = 1)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _view(spark, d, s=None, merge=SUM):
    return resolve(*event_log(spark, d), s, merge)


@query(f"WITH {LOG}, {view_sql()} SELECT user_key, seq, value FROM view_")
def latest_view(spark, d):
    return _view(spark, d)


@query(f"WITH {LOG}, {view_sql(at_sql(HALF))} SELECT user_key, seq, value FROM view_")
def as_of_view(spark, d):
    return _view(spark, d, at(spark, d, HALF))


_KEYS = "SELECT CAST(custkey AS BIGINT) AS idx, printf('user%012d', (custkey * 7) % 400) AS user_key FROM (SELECT c_custkey AS custkey FROM customer)"


def _keys(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("idx"), key_of(F.col("c_custkey") * 7 % 400).alias("user_key"))


@query(f"WITH {LOG}, {view_sql()}, keys AS ({_KEYS}) SELECT idx, k.user_key, seq, value FROM keys k LEFT JOIN view_ v ON k.user_key = v.user_key")
def multi_get(spark, d):
    return reads.multi_get(_view(spark, d), _keys(spark, d))


@query(f"WITH {LOG}, {view_sql()}, keys AS ({_KEYS}) SELECT idx, k.user_key, coalesce(seq, 0) AS seq, value FROM keys k LEFT JOIN view_ v ON k.user_key = v.user_key")
def get_for_update(spark, d):
    return reads.get_for_update(_view(spark, d), _keys(spark, d))


@query(f"WITH {LOG}, {view_sql()} SELECT * FROM view_ WHERE user_key = 'user000000000007'")
def point_get(spark, d):
    log, rd = event_log(spark, d)
    return reads.get(resolve(reads.get(log, "user000000000007"), rd), "user000000000007")


@query(f"WITH {LOG}, {view_sql()} SELECT * FROM view_ WHERE user_key >= 'user000000000020' AND user_key < 'user000000000060'")
def range_scan(spark, d):
    log, rd = event_log(spark, d)
    return resolve(reads.scan(log, "user000000000020", "user000000000060"), rd)


@query(f"WITH {LOG}, {view_sql()} SELECT * FROM view_ WHERE starts_with(user_key, 'user00000000001')")
def prefix_scan(spark, d):
    log, rd = event_log(spark, d)
    return resolve(reads.scan(log, prefix="user00000000001"), rd)


@query(f"WITH {LOG}, {view_sql()} SELECT * FROM view_ WHERE user_key >= 'user000000000031x' ORDER BY user_key LIMIT 1")
def seek_first(spark, d):
    return reads.seek(_view(spark, d), "user000000000031x")


@query(f"WITH {LOG}, {view_sql()} SELECT count(*) AS n, min(user_key) AS first_key, max(user_key) AS last_key FROM view_")
def unbounded_scan(spark, d):
    return reads.scan(_view(spark, d)).agg(F.count("*").alias("n"), F.min("user_key").alias("first_key"), F.max("user_key").alias("last_key"))


@query(f"WITH {LOG}, x AS (SELECT user_key, arg_max(kind, seq) AS kind, max(seq) AS seq FROM log GROUP BY user_key) SELECT user_key, seq FROM x WHERE kind = 0")
def point_tombstones(spark, d):
    log, _ = event_log(spark, d)
    return log.groupBy("user_key").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq")).where("kind = 0").select("user_key", "seq")


@query(f"WITH {LOG}, {live_sql('1000000000')} SELECT user_key, seq, kind FROM log EXCEPT SELECT user_key, seq, kind FROM live")
def range_delete_view(spark, d):
    log, rd = event_log(spark, d)
    return log.select("user_key", "seq", "kind").exceptAll(uncovered(log, rd).select("user_key", "seq", "kind"))


@query(f"WITH {LOG}, {live_sql(at_sql(QUARTER))} SELECT user_key, count(*) AS n, max(seq) AS seq FROM live GROUP BY user_key")
def range_delete_as_of(spark, d):
    log, rd = event_log(spark, d)
    return uncovered(log, rd, at(spark, d, QUARTER)).groupBy("user_key").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))


QUERIES["merge_sum"] = lambda spark, d: _view(spark, d, merge=SUM)
ORACLE_SQL["merge_sum"] = f"WITH {LOG}, {view_sql()} SELECT * FROM view_"
QUERIES["merge_max"] = lambda spark, d: _view(spark, d, merge=MAX)
ORACLE_SQL["merge_max"] = f"WITH {LOG}, {view_sql(fold='max(CASE WHEN kind <> 0 THEN value END)')} SELECT * FROM view_"
QUERIES["merge_min"] = lambda spark, d: _view(spark, d, merge=MIN)
ORACLE_SQL["merge_min"] = f"WITH {LOG}, {view_sql(fold='min(CASE WHEN kind <> 0 THEN value END)')} SELECT * FROM view_"
QUERIES["merge_append"] = lambda spark, d: _view(spark, d, merge=APPEND)
ORACLE_SQL["merge_append"] = f"""WITH {LOG}, {view_sql(fold="string_agg(CASE WHEN kind <> 0 THEN CAST(value AS VARCHAR) END, ',' ORDER BY seq)")} SELECT * FROM view_"""


@query(f"WITH {LOG}, {view_sql(fold='CAST(sum(CASE WHEN kind = 1 THEN value WHEN kind = 2 THEN 2 * value END) AS BIGINT)')} SELECT * FROM view_")
def merge_hof(spark, d):
    twice = ordered_fold("twice", lambda a, x: a + F.when(x["k"] == 2, 2 * x["v"]).otherwise(x["v"]), F.lit(0).cast("long"), lambda a, b: a + b)
    return _view(spark, d, merge=twice)


@query(f"WITH {LOG}, {view_sql()} SELECT user_key, count(*) FILTER (kind = 2) AS operands, base FROM tview_ WHERE base IS NULL OR seq >= base GROUP BY user_key, base")
def merge_chain_length(spark, d):
    return chains(uncovered(*event_log(spark, d))).groupBy("user_key", "base").agg(F.count(F.when(F.col("kind") == 2, 1)).alias("operands"))


@query(f"WITH {LOG}, {view_sql(at_sql(QUARTER), name='a_')}, {view_sql(at_sql(HALF), name='b_')} SELECT coalesce(a_.user_key, b_.user_key) AS user_key, a_.value AS old_value, b_.value AS new_value FROM a_ FULL JOIN b_ ON a_.user_key = b_.user_key WHERE a_.seq IS DISTINCT FROM b_.seq")
def snapshot_diff(spark, d):
    log, rd = event_log(spark, d)
    a = resolve(log, rd, at(spark, d, QUARTER)).select("user_key", F.col("seq").alias("a"), F.col("value").alias("old_value"))
    b = resolve(log, rd, at(spark, d, HALF)).select("user_key", F.col("seq").alias("b"), F.col("value").alias("new_value"))
    return a.join(b, "user_key", "full").where("NOT (a <=> b)").select("user_key", "old_value", "new_value")


_COMPACT = "SELECT user_key, seq, kind, value FROM log WHERE seq > {s} UNION ALL SELECT user_key, seq, 1 AS kind, value FROM view_"


@query(f"WITH {LOG}, {view_sql()} SELECT user_key, seq, 1 AS kind, value FROM view_")
def compact_full(spark, d):
    return compaction.compact(*event_log(spark, d), 10**9)


@query(f"WITH {LOG}, {view_sql(at_sql(THIRD))} {_COMPACT.format(s=at_sql(THIRD))}")
def compact_keep_snapshot(spark, d):
    return compaction.compact(*event_log(spark, d), at(spark, d, THIRD))


@query(f"""WITH {LOG}, {live_sql(at_sql(THIRD))}, b AS (SELECT user_key, max(CASE WHEN kind <> 2 THEN seq END) AS base, max(seq) AS head FROM live GROUP BY user_key),
m AS (SELECT l.*, v.seq IS NOT NULL AS is_live, b.base, b.head FROM log l LEFT JOIN live v ON l.seq = v.seq LEFT JOIN b ON l.user_key = b.user_key)
SELECT CASE WHEN seq > {at_sql(THIRD)} THEN 'newer' WHEN NOT is_live THEN 'ranged' WHEN seq < base THEN 'covered' WHEN seq < head THEN 'folded' WHEN kind = 0 THEN 'deletion' ELSE 'kept' END AS reason, count(*) AS n FROM m GROUP BY 1""")
def compact_drop_reasons(spark, d):
    return compaction.reasons(*event_log(spark, d), at(spark, d, THIRD)).groupBy("reason").agg(F.count("*").alias("n"))


_LO, _HI = "user000000000020", "user000000000090"


@query(f"WITH {LOG}, {view_sql()} SELECT user_key, seq, kind, value FROM log WHERE NOT (user_key >= '{_LO}' AND user_key < '{_HI}') UNION ALL SELECT user_key, seq, 1, value FROM view_ WHERE user_key >= '{_LO}' AND user_key < '{_HI}'")
def compact_range(spark, d):
    log, rd = event_log(spark, d)
    inside = (F.col("user_key") >= _LO) & (F.col("user_key") < _HI)
    return log.where(~inside).unionByName(compaction.compact(log.where(inside), rd, 10**9))


_SMALL = f"{view_sql(at_sql(THIRD), name='c_')}, small AS (SELECT user_key, seq, kind, value FROM log WHERE seq > {at_sql(THIRD)} UNION ALL SELECT user_key, seq, 1, value FROM c_)"
_LATER = {"third": at_sql(THIRD), "half": at_sql(HALF), "whole": at_sql(1)}


@query(
    f"WITH {LOG}, {_SMALL}, " + ", ".join(f"{view_sql(s, name=f'a{k}')}, {view_sql(s, name=f'b{k}', log='small')}" for k, s in _LATER.items()) + " "
    + " UNION ALL ".join(f"SELECT '{k}' AS snapshot, (SELECT count(*) FROM b{k}) AS keys, (SELECT CAST(sum(value) AS BIGINT) FROM b{k}) AS total, (SELECT count(*) FROM ((SELECT * FROM a{k} EXCEPT SELECT * FROM b{k}) UNION ALL (SELECT * FROM b{k} EXCEPT SELECT * FROM a{k})) x) AS differences" for k in _LATER)
)
def compact_view_equality(spark, d):
    """The views of a log and of its compaction, at the snapshot kept and later ones."""
    log, rd = event_log(spark, d)
    third = at(spark, d, THIRD)
    small, out = tables.written(compaction.compact(log, rd, third), "small"), []
    for k, part in {"third": THIRD, "half": HALF, "whole": 1}.items():
        s = at(spark, d, part)
        a, b = resolve(log, rd, s), resolve(small, rd, s)
        both = a.select("user_key", "seq", "value", F.lit(1).alias("side")).unionByName(b.select("user_key", "seq", "value", F.lit(2).alias("side")))
        rows = both.groupBy("user_key", "seq", "value").agg(F.sum("side").alias("sides"))  # 3: in both
        mine = F.col("sides") >= 2
        out.append(rows.agg(F.count_if(mine).alias("keys"), F.sum(F.when(mine, F.col("value"))).alias("total"), F.count_if(F.col("sides") != 3).alias("differences")).select(F.lit(k).alias("snapshot"), "keys", "total", "differences"))
    return out[0].unionAll(out[1]).unionAll(out[2])


@query(f"WITH {LOG}, {view_sql()} SELECT user_key, seq, 1 AS kind, value FROM view_ WHERE NOT (value % 3 = 0)")
def compaction_filter_drop(spark, d):
    return compaction.compact(*event_log(spark, d), 10**9, drop=F.col("value") % 3 == 0)


@query(f"WITH {LOG}, {view_sql(at_sql(THIRD))} SELECT user_key, seq, kind, value FROM log WHERE seq > {at_sql(THIRD)} UNION ALL SELECT user_key, seq, 1, value FROM view_ WHERE NOT (value % 3 = 0)")
def filter_min_snapshot(spark, d):
    return compaction.compact(*event_log(spark, d), at(spark, d, THIRD), drop=F.col("value") % 3 == 0)


_DELTA = f"delta AS (SELECT * FROM log WHERE seq > {at_sql(HALF)}), deep AS (SELECT DISTINCT user_key FROM log WHERE seq <= {at_sql(HALF)})"
_LEVELLED = f"""WITH {LOG}, {_DELTA}, {live_sql('1000000000', 'live', 'delta')}, t AS (SELECT l.*, max(CASE WHEN kind <> 2 THEN seq END) OVER (PARTITION BY l.user_key) AS base, d.user_key IS NOT NULL AS deep FROM live l LEFT JOIN deep d ON l.user_key = d.user_key),
c AS (SELECT * FROM t WHERE base IS NULL OR seq >= base),
f AS (SELECT user_key, max(seq) AS seq, CAST(sum(CASE WHEN kind <> 0 THEN value END) AS BIGINT) AS value, bool_or(kind <> 0) AS found, bool_or(deep) AS deep FROM c WHERE NOT (base IS NULL AND deep) GROUP BY user_key)
SELECT user_key, seq, kind, value FROM c WHERE base IS NULL AND deep
UNION ALL SELECT user_key, seq, CASE WHEN {{gone}} THEN 0 ELSE 1 END, CASE WHEN NOT ({{gone}}) THEN value END FROM f WHERE NOT ({{gone}}) OR deep"""


def _levelled(spark, d, drop=None):
    log, rd = event_log(spark, d)
    half = at(spark, d, HALF)
    return compaction.compact(log.where(F.col("seq") > half), rd, 10**9, drop=drop, deeper=log.where(F.col("seq") <= half))


@query(_LEVELLED.format(gone="NOT found"))
def compact_levelled(spark, d):
    return _levelled(spark, d)


@query(_LEVELLED.format(gone="NOT found OR value % 3 = 0"))
def filter_on_flush(spark, d):
    return _levelled(spark, d, F.col("value") % 3 == 0)


@query(f"""WITH {LOG}, w AS (SELECT user_key || '/9' AS start_key, user_key || '/9z' AS end_key, rseq FROM (SELECT start_key AS user_key, rseq FROM rd) UNION ALL SELECT * FROM rd),
{view_sql(at_sql(HALF))}, c AS ({_COMPACT.format(s=at_sql(HALF))}) SELECT start_key, end_key, rseq FROM w WHERE rseq <= {at_sql(HALF)}
AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_key >= w.start_key AND c.user_key < w.end_key)""")
def tombstone_retirement(spark, d):
    """Of the range deletions and as many over empty stretches between keys, those that hold no record after compaction."""
    log, rd = event_log(spark, d)
    half = at(spark, d, HALF)
    narrow = rd.select(F.concat("start_key", F.lit("/9")).alias("start_key"), F.concat("start_key", F.lit("/9z")).alias("end_key"), "rseq")
    return compaction.retired(rd.unionByName(narrow), compaction.compact(log, rd, half), half)


# batches: 64 consecutive events are one batch; a group of writers is 4 batches
@query("SELECT event_id // 64 AS batch, min(event_id + 1) AS first_seq, max(event_id + 1) AS last_seq, count(*) AS n FROM events GROUP BY 1")
def batch_seq_assign(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr("event_id div 64").alias("batch"))
    sizes = e.groupBy("batch").agg(F.count("*").alias("n"))
    # numbers run within a batch; a batch begins after all batches before it
    return running(sizes, ["batch"], "n", "last_seq").select("batch", (F.col("last_seq") - F.col("n") + 1).alias("first_seq"), "last_seq", "n")


@query(f"WITH {LOG} SELECT user_key, (seq - 1) // 64 AS batch, max(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(value, seq) AS value FROM log GROUP BY 1, 2")
def batch_last_wins(spark, d):
    log, _ = event_log(spark, d)
    return log.groupBy("user_key", F.expr("(seq - 1) div 64").alias("batch")).agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"), F.max_by("value", "seq").alias("value"))


@query(f"""WITH {LOG}, c AS (SELECT *, (seq - 1) // 64 AS batch FROM log), r AS (SELECT DISTINCT user_key, batch FROM c)
SELECT r.batch, count(*) AS reads, count(DISTINCT CASE WHEN o.user_key IS NOT NULL THEN r.user_key END) AS stale FROM r
LEFT JOIN (SELECT DISTINCT user_key, batch FROM c) o ON o.user_key = r.user_key AND o.batch = r.batch - 1 GROUP BY 1""")
def checked_commit_conflicts(spark, d):
    """A batch that read its keys two batches ago: which of them the batch before it has changed."""
    log, _ = event_log(spark, d)
    touched = log.select("user_key", F.expr("(seq - 1) div 64").alias("batch")).distinct()
    before = touched.select("user_key", (F.col("batch") + 1).alias("batch"), F.lit(1).alias("hit"))
    return touched.join(before, ["user_key", "batch"], "left").groupBy("batch").agg(F.count("*").alias("reads"), F.count("hit").alias("stale"))


@query("SELECT event_id // 256 AS group_id, count(*) AS records, count(DISTINCT event_id // 64) AS batches FROM events GROUP BY 1")
def group_commit_ratio(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    by_batch = e.groupBy(F.expr("event_id div 64").alias("batch")).agg(F.count("*").alias("n"))
    return by_batch.groupBy(F.expr("batch div 4").alias("group_id")).agg(F.sum("n").alias("records"), F.count("*").alias("batches"))


FILES = """files AS (SELECT CASE WHEN num % 10 = 3 THEN 0 WHEN num % 3 = 0 THEN 1 ELSE 2 END AS level, num, n * 100 AS size, printf('k%010d', lo) AS smallest,
  printf('k%010d', CASE WHEN num % 10 = 3 THEN hi + 5000 ELSE hi END) AS largest FROM (SELECT o_orderkey // 500 AS num, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1))"""


@query(f"WITH {FILES} SELECT level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1")
def level_stats(spark, d):
    return compaction.level_stats(order_files(spark, d))


@query(f"""WITH RECURSIVE {FILES}, reach AS (SELECT num, smallest, largest FROM files WHERE level = 0 AND num = (SELECT min(num) FROM files WHERE level = 0) UNION
SELECT f.num, f.smallest, f.largest FROM files f JOIN reach r ON f.level = 0 AND f.smallest <= r.largest AND f.largest >= r.smallest), b AS (SELECT min(smallest) AS lo, max(largest) AS hi FROM reach)
SELECT level, num FROM files, b WHERE level IN (0, 1) AND smallest <= hi AND largest >= lo AND (SELECT count(*) FROM files WHERE level = 0) >= 2""")
def pick_l0(spark, d):
    return compaction.pick_l0(order_files(spark, d), 2).select("level", "num")


@query(f"""WITH {FILES}, o AS (SELECT min(level) AS level FROM (SELECT level, sum(size) AS b FROM files WHERE level >= 1 GROUP BY 1) WHERE b > 40000 * pow(10, level - 1))
SELECT level, num FROM files WHERE level = (SELECT level FROM o) ORDER BY smallest, num LIMIT 1""")
def pick_by_size(spark, d):
    return compaction.pick_by_size(order_files(spark, d), 40000).select("level", "num")


@query(f"WITH {FILES} SELECT level, num FROM files WHERE level = 1 AND smallest <= 'k0000009000' AND largest >= 'k0000002000'")
def overlapping_files(spark, d):
    return compaction.overlapping(order_files(spark, d), 1, "k0000002000", "k0000009000").select("level", "num")


@query(f"WITH {FILES}, k AS (SELECT printf('k%010d', l_orderkey) AS user_key FROM lineitem WHERE l_linenumber = 1) SELECT k.user_key, f.num FROM k LEFT JOIN files f ON f.level = 1 AND k.user_key BETWEEN f.smallest AND f.largest")
def find_file(spark, d):
    keys = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber = 1").select(F.format_string("k%010d", F.col("l_orderkey")).alias("user_key"))
    return compaction.find_file(order_files(spark, d), keys, 1)


@query(f"WITH {FILES}, k AS (SELECT DISTINCT printf('k%010d', o_orderkey) AS user_key FROM orders) SELECT f.level, count(*) AS probes FROM k JOIN files f ON k.user_key BETWEEN f.smallest AND f.largest GROUP BY 1")
def read_amplification(spark, d):
    """Files that a read of every key could touch, by level."""
    files = order_files(spark, d)
    keys = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k")).distinct()
    spans = files.select("level", F.substring("smallest", 2, 10).cast("long").alias("lo"), F.substring("largest", 2, 10).cast("long").alias("hi"))
    # a file is dealt to each run of 500 keys that it spans
    spans = spans.withColumn("run", F.explode(F.expr("sequence(lo div 500, hi div 500)")))
    hit = keys.withColumn("run", F.expr("k div 500")).join(spans, "run").where("k BETWEEN lo AND hi")
    return hit.groupBy("level").agg(F.count("*").alias("probes"))


_EDITS = "SELECT l_partkey % 300 AS num, l_orderkey * 10 + l_linenumber AS edit, CASE WHEN l_returnflag = 'R' THEN 'delete' ELSE 'add' END AS action FROM lineitem"


def _edits(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select((F.col("l_partkey") % 300).alias("num"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edit"), F.when(F.col("l_returnflag") == "R", "delete").otherwise("add").alias("action"))


@query(f"WITH e AS (SELECT num, max(struct_pack(edit := edit, action := action)) AS x FROM ({_EDITS}) GROUP BY num) SELECT num, x.edit AS edit FROM e WHERE x.action = 'add'")
def manifest_replay(spark, d):
    last = _edits(spark, d).groupBy("num").agg(F.max(F.struct("edit", "action")).alias("x"))
    return last.where("x.action = 'add'").select("num", "x.edit")


@query(f"WITH e AS (SELECT num, max(struct_pack(edit := edit, action := action)) AS x FROM ({_EDITS}) GROUP BY num) SELECT p_partkey AS num FROM part WHERE p_partkey < 300 AND p_partkey NOT IN (SELECT num FROM e WHERE x.action = 'add')")
def orphan_files(spark, d):
    listed = spark.read.parquet(f"{d}/part.parquet").where("p_partkey < 300").select(F.col("p_partkey").alias("num"))
    return listed.join(manifest_replay(spark, d).select("num"), "num", "left_anti")


@query(f"WITH {LOG} SELECT user_key, seq, kind, hex(user_key) || printf('%016X', seq * 256 + kind) AS internal_key FROM log")
def internal_key_codec(spark, d):
    log, _ = event_log(spark, d)
    coded = log.select(codec.internal_key(F.col("user_key"), F.col("seq"), F.col("kind")).alias("k"))
    return coded.select(codec.user_key_of(F.col("k")).alias("user_key"), codec.seq_of(F.col("k")).alias("seq"), codec.kind_of(F.col("k")).alias("kind"), F.hex("k").alias("internal_key"))


@query("WITH x AS (SELECT DISTINCT p_brand AS prefix FROM part) SELECT prefix, left(prefix, length(prefix) - 1) || chr(CAST(ascii(right(prefix, 1)) + 1 AS INTEGER)) AS successor FROM x")
def prefix_successor(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("prefix")).distinct()
    return p.select("prefix", F.concat(F.expr("left(prefix, length(prefix) - 1)"), F.char(F.ascii(F.expr("right(prefix, 1)")) + 1)).alias("successor"))


@query("WITH x AS (SELECT o_orderkey * o_custkey AS x FROM orders) SELECT x, CASE WHEN x < 128 THEN 1 WHEN x < 16384 THEN 2 WHEN x < 2097152 THEN 3 WHEN x < 268435456 THEN 4 WHEN x < 34359738368 THEN 5 ELSE 6 END AS bytes FROM x")
def uvarint_len(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") * F.col("o_custkey")).alias("x"))
    return o.select("x", codec.uvarint_length(F.col("x")).alias("bytes"))


@query("WITH x AS (SELECT o_orderkey AS x FROM orders) SELECT x, CASE WHEN x < 128 THEN printf('%02X', x) WHEN x < 16384 THEN printf('%02X%02X', x % 128 + 128, x // 128) WHEN x < 2097152 THEN printf('%02X%02X%02X', x % 128 + 128, (x // 128) % 128 + 128, x // 16384) ELSE printf('%02X%02X%02X%02X', x % 128 + 128, (x // 128) % 128 + 128, (x // 16384) % 128 + 128, x // 2097152) END AS coded FROM x")
def uvarint_bytes(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("x"))
    return o.select("x", F.hex(codec.uvarint(F.col("x"))).alias("coded"))


@query("""WITH k AS (SELECT DISTINCT c_name AS k FROM customer), p AS (SELECT k, lag(k) OVER (PARTITION BY left(k, 12) ORDER BY k) AS b FROM k)
SELECT k, (SELECT max(i) FROM range(0, 64) r(i) WHERE i <= least(length(k), length(b)) AND left(k, i) = left(b, i)) AS shared FROM p WHERE b IS NOT NULL""")
def shared_prefix_len(spark, d):
    k = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("k")).distinct()
    p = k.withColumn("b", F.lag("k").over(Window.partitionBy(F.substring("k", 1, 12)).orderBy("k"))).where("b IS NOT NULL")
    return p.select("k", codec.shared_prefix(F.col("k"), F.col("b")).cast("long").alias("shared"))


@query(f"WITH {LOG}, {view_sql(at_sql(HALF))} SELECT user_key, seq, value FROM view_")
def checkpoint_view(spark, d):
    """A checkpoint of half of the log, written to the shared folder and opened there."""
    log, rd = event_log(spark, d)
    return resolve(*tables.opened(spark, tables.checkpoint(log, rd, at(spark, d, HALF))))


@query(f"WITH {LOG}, x AS (SELECT * FROM log WHERE (seq - 1) // 64 < (SELECT count(*) // 64 FROM events)), {view_sql(log='x')} SELECT user_key, seq, value FROM view_")
def recovery_truncated_tail(spark, d):
    """The last batch is not whole: recovery leaves it out."""
    log, rd = event_log(spark, d)
    last = F.expr(f"{spark.read.parquet(f'{d}/events.parquet').count()} div 64")
    return resolve(log.where(F.expr("(seq - 1) div 64") < last), rd)


_BATCH = f"""bt AS (SELECT o_orderkey AS "at", printf('user%012d', o_custkey) AS user_key, CAST(round(o_totalprice) AS BIGINT) AS value,
  CASE WHEN o_orderkey % 50 = 7 THEN 'delete_range' WHEN o_orderstatus = 'F' THEN 'put' WHEN o_orderpriority LIKE '1%' THEN 'delete' ELSE 'merge' END AS op FROM orders),
nb AS (SELECT *, row_number() OVER (ORDER BY "at") + {at_sql(1)} AS seq FROM bt),
log2 AS (SELECT * FROM log UNION ALL SELECT user_key, seq, CASE op WHEN 'put' THEN 1 WHEN 'delete' THEN 0 ELSE 2 END, CASE WHEN op <> 'delete' THEN value END FROM nb WHERE op <> 'delete_range'),
rd2 AS (SELECT * FROM rd UNION ALL SELECT user_key, user_key || '~', seq FROM nb WHERE op = 'delete_range')"""
_WRITTEN = view_sql(name="x_", log="log2").replace("FROM rd r", "FROM rd2 r")


def _batch(spark, d) -> DataFrame:
    """A batch of one request for each row of ``orders``."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    key = key_of(F.col("o_custkey"))
    op = F.when(F.col("o_orderkey") % 50 == 7, "delete_range").when(F.col("o_orderstatus") == "F", "put").when(F.col("o_orderpriority").startswith("1"), "delete").otherwise("merge")
    return o.select(F.col("o_orderkey").alias("at"), op.alias("op"), key.alias("user_key"), F.round("o_totalprice").cast("long").alias("value"), F.concat(key, F.lit("~")).alias("end_key"))


@query(f"WITH {LOG}, {_BATCH} SELECT user_key, seq, CASE op WHEN 'put' THEN 1 WHEN 'delete' THEN 0 WHEN 'merge' THEN 2 ELSE 3 END AS kind, CASE WHEN op IN ('put', 'merge') THEN value END AS value FROM nb")
def write_batch(spark, d):
    """The numbered records of a batch of puts, deletes, merges and range deletions."""
    return writes.numbered(_batch(spark, d), writes.last_seq(*event_log(spark, d))).drop("end_key")


@query(f"WITH {LOG}, {_BATCH}, {_WRITTEN} SELECT user_key, seq, value FROM x_")
def write_batch_view(spark, d):
    """What the log says after that batch."""
    return resolve(*writes.write(*event_log(spark, d), _batch(spark, d)))


@query("""SELECT o_orderkey AS "at", CASE WHEN o_orderkey % 7 = 0 THEN 'EmptyKey' WHEN o_orderkey % 50 = 7 AND o_orderkey % 2 = 1 THEN 'InvalidRange' WHEN NOT (o_orderkey % 50 = 7 OR o_orderstatus = 'F' OR o_orderpriority LIKE '1%') THEN 'NoMergeOperator' END AS error FROM orders""")
def write_errors(spark, d):
    """What is wrong with each request of a batch against a log without merge operator."""
    broken = _batch(spark, d).withColumn("user_key", F.when(F.col("at") % 7 == 0, "").otherwise(F.col("user_key")))
    broken = broken.withColumn("end_key", F.when(F.col("at") % 2 == 1, F.col("user_key")).otherwise(F.col("end_key")))
    return broken.select("at", writes.error_of(merges=False).alias("error"))


@query(f"""WITH {LOG}, {view_sql()}, {view_sql(at_sql(HALF), name='h_')}, rs AS (SELECT 'user' || printf('%012d', c_custkey) AS user_key FROM customer)
SELECT rs.user_key, coalesce(h_.seq, 0) AS seq, coalesce(v.seq, 0) AS now FROM rs LEFT JOIN h_ ON h_.user_key = rs.user_key LEFT JOIN view_ v ON v.user_key = rs.user_key WHERE coalesce(h_.seq, 0) <> coalesce(v.seq, 0)""")
def checked_commit(spark, d):
    """What a commit that read its keys at half of the log finds changed at the end."""
    log, rd = event_log(spark, d)
    keys = spark.read.parquet(f"{d}/customer.parquet").select(key_of(F.col("c_custkey")).alias("user_key"), F.lit(0).alias("idx"))
    read = reads.get_for_update(resolve(log, rd, at(spark, d, HALF)), keys).select("user_key", "seq")
    return writes.checked(resolve(log, rd), read)


@query(f"WITH {LOG} SELECT CAST(2 AS BIGINT) AS live_snapshots, (SELECT count(*) FROM rd) AS range_deletions, {at_sql(1)} AS last_seq")
def log_statistics(spark, d):
    log, rd = event_log(spark, d)
    live = [writes.Snapshot(log, rd, at(spark, d, part)) for part in (QUARTER, THIRD, HALF)]
    live[0].release()
    return writes.statistics(log, rd, live)


@query(f"WITH {LOG}, {view_sql()} SELECT user_key, seq, value FROM view_")
def streamed_log_view(spark, d):
    """The latest view of the log that a stream of ``events`` as write requests leaves."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(f"{d}/events.parq*")
    op = F.when(F.col("event_id") % 1000 == 500, "delete_range").when(F.col("event_type").isin("signup", "view"), "put").when(F.col("event_type") == "error", "delete").otherwise("merge")
    asked = e.select(F.col("event_id").alias("at"), op.alias("op"), key_of(F.col("user_id")).alias("user_key"), F.round(F.col("value") * 100).cast("long").alias("value"), key_of(F.col("user_id") + 5).alias("end_key"))
    path = f"{tables.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.ingest(asked, f"{path}/log", f"{path}/progress").awaitTermination()
    return resolve(*stream.log_of(spark, f"{path}/log"))


@query(f"WITH {LOG}, {view_sql()} SELECT user_key, seq, value FROM view_ WHERE reverse(user_key) >= reverse('user000000000040') AND reverse(user_key) < reverse('user000000000007')")
def custom_order_scan(spark, d):
    """A scan in the order of keys read backwards."""
    return reads.scan(_view(spark, d), "user000000000040", "user000000000007", order=F.reverse)


@query(f"WITH {LOG}, {view_sql()}, keys AS ({_KEYS}), k2 AS (SELECT idx, CASE WHEN idx % 10 = 0 THEN '' ELSE user_key END AS user_key FROM keys) SELECT idx, k.user_key, seq, value, CASE WHEN k.user_key = '' THEN 'EmptyKey' END AS error FROM k2 k LEFT JOIN view_ v ON k.user_key = v.user_key")
def multi_get_slots(spark, d):
    """A batch of keys, some of them empty: these fail alone."""
    keys = _keys(spark, d).withColumn("user_key", F.when(F.col("idx") % 10 == 0, "").otherwise(F.col("user_key")))
    return reads.multi_get(_view(spark, d), keys, errors=True)


workload.register(QUERIES, ORACLE_SQL, LOG, view_sql)
