"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are hashed TF-IDF weights of character 1- to ``ORDER``-grams.  Document frequencies
cover all training rows.  The classifier is fitted on a bounded sample, ``per_lang`` rows of each
language: ``shards`` tasks run follow-the-regularised-leader with L1 and L2 penalties, and the
mean of their weights is the model.  A part of the sample that no shard sees sets the
temperature that calibrates the scores.

A text is read whole, lower-cased, with each run of non-letters as one space.  Null texts and
texts without a letter get ``und`` with score 0; so does every text if nothing can be learned.
Rows without a language are not learned from.  Ties go to the alphabetically first language.
Repeated rows count as often as they occur; extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import mixed, name, slices, with_text_columns, written

BUCKETS = 1 << 15
ORDER = 3
TEMPERATURES = [round(0.05 * 1.15**i, 4) for i in range(36)]


class Grams:
    """Counts of hashed character n-grams; ``None`` for a text without a letter."""

    def __init__(self):
        self.fold = np.full(0x110000, 32, np.uint32)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                self.fold[ord(c)] = ord(low) if len(low := c.lower()) == 1 else ord(c)

    def __call__(self, text: str | None) -> np.ndarray | None:
        if not text:
            return None
        x = self.fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = x == 32
        keep = ~blank
        if not keep.any():
            return None
        keep[1:] |= blank[1:] & ~blank[:-1]
        x = np.concatenate(([32], x[keep], [32])).astype(np.uint64)
        counts = np.zeros(BUCKETS, np.int64)
        code = x
        for n in range(1, ORDER + 1):
            if n > 1:
                code = code[:-1] * np.uint64(0x110000) + x[n - 1 :]
            counts += np.bincount((mixed(code + np.uint64(n << 62)) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        return counts


def weights(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Follow-the-regularised-leader over ``rows`` of (buckets, weights, class)."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def solved(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            za, na = z[at], n[at]
            w = solved(za, na)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / alpha * w
            n[at] = na + g * g
    return solved(z, n)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0


def document_frequencies(df: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows, and how many have a letter."""

    def run(batches):
        grams, seen, rows = Grams(), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    if (counts := grams(text)) is not None:
                        seen += counts > 0
                        rows += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], rows))], ["bucket", "n"])

    found = df.select(name(text_col)).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS + 1 rows at most
    seen = np.zeros(BUCKETS, np.int64)
    own = found[found.bucket >= 0]
    seen[own.bucket.to_numpy(np.int64)] = own.n
    return seen, int(found[found.bucket < 0].n.sum())


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1000, shards: int = 4,
    epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01,
) -> Model:
    """A model from all rows of ``labelled`` (statistics) and a bounded sample (weights).

    ``per_lang``: rows of each language in the sample, about; a language with fewer gives all."""
    labelled = labelled.select(name(id_col).alias("doc_id"), name(text_col).alias("text"), name(lang_col).alias("lang")).where(F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)))
    seen, rows = document_frequencies(labelled, "text")
    idf = np.log((1 + rows) / (1 + seen)) + 1
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(idf)  # BUCKETS numbers
    pairs = [F.lit(v) for k in langs for v in (k, counts[k])]
    where = {k: i for i, k in enumerate(langs)}
    digest = lambda seed: F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))  # noqa: E731  of the whole row: ids may repeat or be null
    sample = labelled.where(F.pmod(digest(1), F.create_map(*pairs)[F.col("lang")]) < per_lang).select(
        "doc_id", "text", "lang", F.when(F.pmod(digest(2), F.lit(5)) == 0, -1).otherwise(F.pmod(digest(3), F.lit(shards))).cast("int").alias("shard"), digest(4).alias("order")
    )
    sample = sample.dropDuplicates(["doc_id", "text", "lang"])  # equal rows are drawn together, and count once

    def features():
        grams = Grams()

        def run(texts):
            made = [(np.empty(0, np.int64), np.empty(0)) if c is None else weights(c, shared.value) for c in map(grams, texts)]
            return pa.array([a for a, _ in made], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in made], pa.list_(pa.float32()))

        return run

    fields = [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType()))]
    sample = written(with_text_columns(sample, "text", features, fields, ["doc_id", "lang", "shard", "order"]), "langid")

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id"])
        data = [(a.astype(np.int64), x.astype(float), where[k]) for a, x, k in zip(rows["at"], rows["x"], rows["lang"]) if len(a)]
        w = ftrl(data, len(langs), epochs, alpha, beta, l1, l2)
        at = np.flatnonzero(np.abs(w).sum(1))
        return pd.DataFrame({"bucket": np.repeat(at, len(langs)), "lang": np.tile(np.arange(len(langs)), len(at)), "w": w[at].ravel()})

    learned = sample.where("shard >= 0").groupBy("shard").applyInPandas(train, "bucket long, lang int, w double")
    # bounded by BUCKETS times languages; rounded, so that the order of the sum does not show
    learned = learned.groupBy("bucket", "lang").agg(F.round(F.sum("w") / shards, 9).alias("w")).toPandas()
    w = np.zeros((BUCKETS, len(langs)))
    w[learned["bucket"].to_numpy(np.int64), learned["lang"].to_numpy(np.int64)] = learned["w"]
    model = Model(langs, idf, w)
    model.temperature = calibrated(sample.where("shard < 0"), model)
    return model


def calibrated(sample: DataFrame, model: Model) -> float:
    """The temperature of least loss on rows with features ``at`` and ``x`` and a language."""
    w = sample.sparkSession.sparkContext.broadcast(model.weights)
    where = {k: i for i, k in enumerate(model.langs)}
    t = np.array(TEMPERATURES)

    def run(frames):
        for rows in frames:
            losses = []
            for a, x, k in zip(rows["at"], rows["x"], rows["lang"]):
                if len(a):
                    z = (x @ w.value[a])[None, :] / t[:, None]
                    z -= z.max(1, keepdims=True)
                    losses.append(np.log(np.exp(z).sum(1)) - z[:, where[k]])
            yield pd.DataFrame({"i": np.tile(np.arange(len(t)), len(losses)), "loss": np.concatenate(losses) if losses else np.empty(0)})

    found = sample.select("at", "x", "lang").mapInPandas(run, "i int, loss double").groupBy("i").agg(F.round(F.sum("loss"), 6).alias("loss")).orderBy("loss", "i").first()
    return float(t[found["i"]]) if found else 1.0


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its calibrated probability, as ``names``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language

    def make():
        grams, m = Grams(), shared.value

        def one(text):
            counts = grams(text) if m.langs else None
            if counts is None:
                return "und", 0.0
            at, x = weights(counts, m.idf)
            p = softmax((x @ m.weights[at]) / m.temperature)
            return m.langs[int(p.argmax())], float(p.max())

        return lambda texts: [*zip(*map(one, texts))]

    return with_text_columns(df, text_col, make, [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())], keep)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(name(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
