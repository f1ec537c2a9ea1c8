"""Ingestion of a stream of write requests: each micro-batch is one batch of the log, numbered after all before it.

Batches lie side by side in the log's folder, each under its number in the stream.  One that was written before a failure is written over when
the stream begins anew from its checkpoint, with the same numbers, so every request is in the log once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.model import RANGE_DELETION
from tidelog.operators.writes import numbered

RECORDS = "user_key string, seq long, kind int, value long, end_key string, batch long"


def records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDS).parquet(path)


def log_of(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The log and its range deletions."""
    rows = records(spark, path)
    ranges = rows.where(F.col("kind") == RANGE_DELETION).select(F.col("user_key").alias("start_key"), "end_key", F.col("seq").alias("rseq"))
    return rows.where(F.col("kind") != RANGE_DELETION).select("user_key", "seq", "kind", "value"), ranges


def ingest(requests: DataFrame, path: str, checkpoint: str, merges: bool = True) -> StreamingQuery:
    """Starts writing a stream of requests (at, op, user_key, value, end_key) to the log in ``path``; ends when what is there is written."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = records(spark, path).where(F.col("batch") < number).agg(F.max("seq")).first()[0] if number else None
        numbered(batch, before or 0, merges).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
