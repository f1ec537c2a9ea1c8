"""Logs as tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it (a test) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir: no folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def checkpoint(log: DataFrame, ranges: DataFrame, snapshot: int, path: str | None = None) -> str:
    """Writes what the log has up to a snapshot, as a log of its own; its folder."""
    path = path or f"{shared_dir(log.sparkSession)}/checkpoint-{uuid.uuid4().hex}"
    log.where(F.col("seq") <= snapshot).write.parquet(f"{path}/log")
    ranges.where(F.col("rseq") <= snapshot).write.parquet(f"{path}/ranges")
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: what reads it several times does not work it out, or plan it, each time."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/log"), spark.read.parquet(f"{path}/ranges")
