"""Change logs and file tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def key_of(c) -> object:
    return F.format_string("user%012d", c)


def event_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The log of ``events``, one record an event, and its range deletions."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    kind = F.when(F.col("event_id") % 1000 == 500, 3).when(F.col("event_type").isin("signup", "view"), 1).when(F.col("event_type") == "error", 0).otherwise(2)
    rows = e.select(
        key_of(F.col("user_id")).alias("user_key"), (F.col("event_id") + 1).alias("seq"), kind.alias("kind"),
        F.round(F.col("value") * 100).cast("long").alias("value"), key_of(F.col("user_id") + 5).alias("end_key"),
    )
    return rows.where("kind <> 3").drop("end_key"), rows.where("kind = 3").select(F.col("user_key").alias("start_key"), "end_key", F.col("seq").alias("rseq"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of files over ``orders``: level, num, size, smallest, largest.

    Each run of 500 order keys is a file; every tenth lies in level 0, each spans two runs there."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    run = F.expr("o_orderkey div 500")
    name = lambda c: F.format_string("k%010d", c)
    f = o.groupBy(run.alias("num")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    level = F.when(F.col("num") % 10 == 3, 0).when(F.col("num") % 3 == 0, 1).otherwise(2)
    hi = F.when(F.col("num") % 10 == 3, F.col("hi") + 5000).otherwise(F.col("hi"))
    return f.select(level.alias("level"), "num", (F.col("n") * 100).alias("size"), name("lo").alias("smallest"), name(hi).alias("largest"))
