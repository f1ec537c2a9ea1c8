"""Helpers that the operators share: tables, shared scratch space, text mapping."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: For the length of a job: shuffle files go when it ends; an Arrow batch, held by JVM and Python at once, has few texts.
_LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "512"}
#: Rows of an Arrow batch that are held as Python objects at once.
SLICE = 64
#: Entries of a per-task memo of words; a full memo starts anew.
MEMO = 150_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir: no folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextlib.contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Settings that keep the jobs started inside small on disk and in memory."""
    before = {k: spark.conf.get(k, None) for k in _LEAN}
    for k, v in _LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, tag: str, paths: dict | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage.

    Its shuffle files go as soon as it is written, not when the driver next collects garbage.
    ``paths`` gets its place."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with lean(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if paths is not None:
        paths[id(out)] = path, out
    return out


class Scratch:
    """Tables in the shared folder that can be dropped as soon as no step reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        return written(df, tag, self.paths)

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[0])
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def name(column: str):
    """A column by its plain name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(columns: Sequence[str], base: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in columns}
    while base in taken:
        base += "_"
    return base


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, SLICE):
        yield batch.slice(start, SLICE)


def with_text_columns(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[list], Sequence[Sequence]]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    as_bytes: bool = False,
) -> DataFrame:
    """``keep`` columns of ``df`` and, from each text, new columns.

    ``make()`` runs once a task and returns a function from a list of texts to one
    list a new column.  A kept column with the name of a new one is replaced."""
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    inside = text_col in kept
    # numbered inside: a user's column may have any name
    source = df.select(*(name(c).alias(f"c{i}") for i, c in enumerate(kept)), *([] if inside else [name(text_col).alias(f"c{len(kept)}")]))
    n = len(kept)
    at = kept.index(text_col) if inside else n
    schema = T.StructType([*source.schema.fields[:n], *(T.StructField(f"c{n + i}", f.dataType) for i, f in enumerate(fields))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch):
                text = part.column(at)
                if as_bytes:
                    text = text.cast(pa.binary())
                made = f(text.to_pylist())
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                columns += [
                    x.cast(arrow.field(n + i).type) if isinstance(x, pa.Array) else pa.array(x, arrow.field(n + i).type)
                    for i, x in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return source.mapInArrow(run, schema).toDF(*kept, *(f.name for f in fields))


class WordHash(dict):
    """64-bit hashes of words (bytes or text), memoised up to ``MEMO`` entries."""

    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` words, in text order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n].copy()
    for i in range(1, k):
        total *= _MULTIPLIER
        total += words[i : n + i]
    return mixed(total + np.uint64(k))
