"""Request mixes over a log, as tables: each event of ``events`` makes one request, in the order of their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import VALUE
from tidelog.operators.ordered import PLACES, running
from tidelog.operators.resolve import resolve
from tidelog.sources.derived import event_log, key_of
from tidelog.sources.tables import written as shared

#: Percent of requests by kind in each mix, keys of a scan, newest keys of read_latest, exponent of the key draw.
MIXES = {
    "a": {"read": 50, "update": 50},
    "b": {"read": 95, "update": 5},
    "c": {"read": 100},
    "d": {"read_latest": 90, "insert": 5, "rmw": 5},
    "e": {"scan": 100},
    "f": {"read": 50, "rmw": 50},
}
SCAN_KEYS = 100
LATEST_KEYS = 1000
ZIPF = 1.1
WRITES = ("update", "insert", "rmw")


def _digest(c: Column, factor: int) -> Column:
    return (c * factor + 12345) % 1000003


def _op(mix: str, roll: Column) -> Column:
    op, upto = None, 0
    for k, percent in MIXES[mix].items():
        upto += percent
        op = (F if op is None else op).when(roll < upto, k)
    return op


def requests(spark, d: str, mix: str) -> DataFrame:
    """id, op and user_key of each request, drawn from the id alone.

    Keys are drawn from all that the table has, the first ones most often (a power law); inserts make new keys after them,
    read_latest draws from the newest of what is there by then.  Where inserts are counted, the requests are written to the shared folder,
    since a mix reads them several times."""
    e = spark.read.parquet(f"{d}/events.parquet")
    keys, last = (x + 1 for x in e.agg(F.max("user_id"), F.max("event_id")).first())
    drawn = e.select(F.col("event_id").alias("id")).select("id", _op(mix, _digest(F.col("id"), 7919) % 100).alias("op"), _digest(F.col("id"), 104729).alias("draw"))
    low = keys ** (1 - ZIPF)
    zipf = F.floor(F.pow((F.lit(low) - 1) * (F.col("draw") / 1000003) + 1, F.lit(1 / (1 - ZIPF)))).cast("long") - 1
    if "insert" not in MIXES[mix]:
        return drawn.select("id", "op", key_of(F.least(zipf, F.lit(keys - 1))).alias("user_key"))
    # ids are dense: key ranges of equal width
    flagged = drawn.withColumn("is_insert", (F.col("op") == "insert").cast("long"))
    counted = running(flagged, ["id"], "is_insert", "inserts", place=F.expr(f"id div {last // PLACES + 1}"))
    newest = F.lit(keys) + F.col("inserts")
    key = F.when(F.col("op") == "insert", newest - 1).when(F.col("op") == "read_latest", newest - 1 - F.col("draw") % F.least(newest, F.lit(LATEST_KEYS))).otherwise(F.least(zipf, F.lit(keys - 1)))
    return shared(counted.select("id", "op", key_of(key).alias("user_key")), "requests")


def requests_sql(mix: str) -> str:
    cases, upto = [], 0
    for k, percent in MIXES[mix].items():
        upto += percent
        cases.append(f"WHEN (event_id * 7919 + 12345) % 1000003 % 100 < {upto} THEN '{k}'")
    return f"""kn AS (SELECT max(user_id) + 1 AS k FROM events), dr AS (SELECT event_id AS id, CASE {' '.join(cases)} END AS op, (event_id * 104729 + 12345) % 1000003 AS draw FROM events),
ct AS (SELECT *, CAST(count(*) FILTER (op = 'insert') OVER (ORDER BY id) AS BIGINT) AS ins FROM dr),
rq AS (SELECT id, op, printf('user%012d', CASE WHEN op = 'insert' THEN k + ins - 1 WHEN op = 'read_latest' THEN k + ins - 1 - draw % least(k + ins, {LATEST_KEYS})
  ELSE least(CAST(floor(pow((pow(k, {1 - ZIPF!r}) - 1) * (CAST(draw AS DOUBLE) / 1000003) + 1, {1 / (1 - ZIPF)!r})) AS BIGINT) - 1, k - 1) END) AS user_key FROM ct, kn)"""


def point_mix(spark, d: str, mix: str) -> DataFrame:
    """By kind of request: how many, how many found their key by then, and how many wrote what is a key's newest value in the end.

    Writes are appended to the log, numbered after it in the order of requests, and the log is resolved again; a request sees the writes of
    all before it."""
    log, ranges = event_log(spark, d)
    asked = requests(spark, d, mix)
    view = resolve(log, ranges).select("user_key", F.lit(True).alias("there"))
    by_key = asked.join(view, "user_key", "left")
    if not set(MIXES[mix]) & set(WRITES):
        return by_key.groupBy("op").agg(F.count("*").alias("n"), F.count("there").alias("hits"), F.lit(0).cast("long").alias("newest"))
    last = spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id")).first()[0] + 1
    written = asked.where(F.col("op").isin(*WRITES)).select("user_key", (F.col("id") + last + 1).alias("seq"), F.lit(VALUE).alias("kind"), F.col("id").alias("value"), "op")
    first = written.groupBy("user_key").agg(F.min("value").alias("first"))
    hit = F.col("there").isNotNull() | (F.col("first") < F.col("id"))
    seen = by_key.join(first, "user_key", "left").groupBy("op").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    after = resolve(log.unionByName(written.drop("op")), ranges).where(F.col("seq") > last)
    newest = written.join(after.select("user_key", "seq"), ["user_key", "seq"], "left_semi").groupBy("op").agg(F.count("*").alias("newest"))
    return seen.join(newest, "op", "left").select("op", "n", "hits", F.coalesce("newest", F.lit(0)).alias("newest"))


def point_mix_sql(log: str, view, mix: str) -> str:
    return f"""WITH {log}, {view()}, {requests_sql(mix)}, la AS (SELECT max(event_id) + 1 AS last FROM events),
wr AS (SELECT user_key, id + last + 1 AS seq, 1 AS kind, id AS value, op FROM rq, la WHERE op IN ('update', 'insert', 'rmw')), fi AS (SELECT user_key, min(value) AS first FROM wr GROUP BY 1),
log2 AS (SELECT * FROM log UNION ALL SELECT user_key, seq, kind, value FROM wr), {view(name='after_', log='log2')},
ne AS (SELECT wr.op, count(*) AS newest FROM wr JOIN after_ a ON a.user_key = wr.user_key AND a.seq = wr.seq GROUP BY 1),
se AS (SELECT op, count(*) AS n, count(*) FILTER (v.user_key IS NOT NULL OR first < id) AS hits FROM rq LEFT JOIN view_ v ON rq.user_key = v.user_key LEFT JOIN fi ON rq.user_key = fi.user_key GROUP BY 1)
SELECT se.op, n, hits, coalesce(newest, 0) AS newest FROM se LEFT JOIN ne ON se.op = ne.op"""


def scan_mix(spark, d: str) -> DataFrame:
    """For each key asked for, how often, and the keys that a scan of ``SCAN_KEYS`` from it on returns.

    Keys are ranked once, by key range; a request is answered from the rank of the first key it reaches."""
    view = resolve(*event_log(spark, d)).select("user_key")
    asked = requests(spark, d, "e").groupBy("user_key").agg(F.count("*").alias("requests"))
    both = view.select("user_key", F.lit(1).alias("own"), F.lit(0).cast("long").alias("requests")).unionByName(asked.select("user_key", F.lit(0).alias("own"), "requests"))
    keys = both.groupBy("user_key").agg(F.max("own").alias("own"), F.max("requests").alias("requests"))
    ranked = running(keys, ["user_key"], "own", "later", descending=True)
    return ranked.where("requests > 0").select("user_key", "requests", F.least("later", F.lit(SCAN_KEYS)).alias("keys"))


def latency(spark, d: str) -> DataFrame:
    """Nearest-rank percentiles, by event type, of the values as if they were latencies.

    Equal values are counted first, so a hot type costs no more than its different values, dealt by range."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    counts = e.groupBy("event_type", "v").agg(F.count("*").alias("n"))
    totals = counts.groupBy("event_type").agg(F.sum("n").alias("total"), F.max("v").alias("most"))
    ranked = running(counts, ["v"], "n", "upto", partition=["event_type"]).join(totals, "event_type")
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1)), F.col("v")))
    return ranked.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("most").alias("most"))


def probe_fit(spark, d: str) -> DataFrame:
    """The least-squares line of the records of a key on its newest number, in thousandths."""
    log, _ = event_log(spark, d)
    k = log.groupBy("user_key").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))
    return k.agg(F.round(F.regr_slope("n", "seq") * 1000, 6).alias("slope"), F.round(F.regr_intercept("n", "seq"), 6).alias("intercept"))


def register(queries: dict, sql: dict, log: str, view) -> None:
    for mix in "abcdf":
        queries[f"ycsb_{mix}"] = lambda spark, d, mix=mix: point_mix(spark, d, mix)
        sql[f"ycsb_{mix}"] = point_mix_sql(log, view, mix)
    queries["ycsb_e"] = scan_mix
    sql["ycsb_e"] = f"WITH {log}, {view()}, {requests_sql('e')}, ky AS (SELECT user_key, count(*) AS requests FROM rq GROUP BY 1) SELECT user_key, requests, least(100, (SELECT count(*) FROM view_ v WHERE v.user_key >= ky.user_key)) AS keys FROM ky"
    queries["latency_nearest_rank"] = latency
    sql["latency_nearest_rank"] = "WITH e AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events), l AS (SELECT event_type, list_sort(list(v)) AS x FROM e GROUP BY 1) SELECT event_type, x[CAST(floor(0.5 * (len(x) - 1)) AS INT) + 1] AS p50, x[CAST(floor(0.95 * (len(x) - 1)) AS INT) + 1] AS p95, x[CAST(floor(0.99 * (len(x) - 1)) AS INT) + 1] AS p99, x[len(x)] AS most FROM l"
    queries["probe_fit"] = probe_fit
    sql["probe_fit"] = f"WITH {log}, k AS (SELECT user_key, count(*) AS n, max(seq) AS seq FROM log GROUP BY 1) SELECT round(regr_slope(n, seq) * 1000, 6) AS slope, round(regr_intercept(n, seq), 6) AS intercept FROM k"
