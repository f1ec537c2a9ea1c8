"""Quality rules with thresholds from mergeable quantile sketches by language and source.

One pass measures every text.  Each measure of each (language, source) goes into a sketch:
counts by logarithmic bucket, whose quantiles are within ``ACCURACY`` of the true ones.
Sketches merge by adding counts, so they are partial aggregates, whatever the skew, and give
the same thresholds however rows are dealt out.  A document is kept if it passes the fixed
rules and no measure lies beyond its group's fences, ``reach`` interquartile ranges (and at
least ``slack``) outside the quartiles.

Null language or source forms a group of its own.  Null and empty texts have no words and fail
the fixed rules.  A group of fewer than ``least`` documents with words is measured by the fences of
its language over all sources, and a language of fewer by those of all rows, whatever
their number.  Repeated rows are measured and judged each; an empty table gives an empty result; texts may have any
length; other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import WordHash, name, windows, with_text_columns, written

#: The signs that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
ACCURACY = 0.01
SALT = 32
_LOG = float(np.log((1 + ACCURACY) / (1 - ACCURACY)))
#: Measure: (what it is of the words, the least distance of a fence from its quartile).
MEASURES = {"word_length": ("word_chars", 3.0), "symbol_rate": ("n_symbols", 0.25), "line_repeats": ("n_dup_lines", 0.02), "word_repeats": ("n_repeat_words", 0.15)}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: bytes, hashes: WordHash) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0
    chars = len(text.translate(None, _SPACE).decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    repeats = 0
    if n >= 9:
        runs = windows(hashes.of(words), 8)
        order = np.argsort(runs, kind="stable")
        same = runs[order][1:] == runs[order][:-1]
        if same.any():
            twice = np.zeros(len(runs) + 1, bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            edges = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + 8, -1)
            repeats = int((np.cumsum(edges[:n]) > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def measured(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    def make():
        hashes = WordHash()
        return lambda texts: [*zip(*(measure(t or b"", hashes) for t in texts))]

    return with_text_columns(df, text_col, make, [T.StructField(c, T.LongType()) for c in _COUNTS], keep, as_bytes=True)


def value_of(measure: str) -> Column:
    return F.col(MEASURES[measure][0]) / F.col("n_words")


def failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """``groups``, measure, bucket, n: mergeable by adding n.  Bucket -2^20 holds zero."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), value_of(k).alias("value")) for k in MEASURES))).alias("m")
    bucket = F.when(F.col("m.value") <= 0, F.lit(-(1 << 20))).otherwise(F.ceil(F.log(F.col("m.value")) / _LOG).cast("int"))
    return rows.where(F.col("n_words") > 0).select(*groups, each).groupBy(*groups, F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, groups: list[str], reach: float, least: int) -> DataFrame:
    """One row a group: low_<measure>, high_<measure>.  Buckets of a group are few (some hundreds)."""
    by = Window.partitionBy(*groups, "measure")
    upto = F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("bucket") == -(1 << 20), 0.0).otherwise(2 * F.exp(F.col("bucket") * _LOG) / (1 + float(np.exp(_LOG))))
    ranked = sketch.select(*groups, "measure", value.alias("value"), upto.alias("upto"), F.sum("n").over(by).alias("total"))
    quartile = [F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("value"))) for k in (1, 3)]
    q = ranked.groupBy(*groups, "measure").agg(quartile[0].alias("q1"), quartile[1].alias("q3"), F.max("total").alias("total"))
    slack = reduce(lambda w, kv: w.when(F.col("measure") == kv[0], kv[1][1]), MEASURES.items(), F).otherwise(0.0)
    reach_of = F.greatest(reach * (F.col("q3") - F.col("q1")), slack)
    q = q.where(F.col("total") >= least).select(*groups, "measure", (F.col("q1") - reach_of).alias("low"), (F.col("q3") + reach_of).alias("high"))
    return q.groupBy(*groups).agg(*(F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"{side}_{k}") for k in MEASURES for side in ("low", "high")))


def all_fences(sketch: DataFrame, reach: float, least: int) -> DataFrame:
    """Fences for every (language, source): its own, or its language's, or those of all rows."""
    lang, groups = ["lang_null", "lang_key"], ["lang_null", "lang_key", "source_null", "source_key"]
    columns = [f"{side}_{k}" for k in MEASURES for side in ("low", "high")]
    merged = lambda by: sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = merged([]).withColumn("every", F.lit(1))
    levels = [
        (fences(sketch, groups, reach, least), groups, "own"),
        (fences(merged(lang), lang, reach, least), lang, "lang"),
        (fences(whole, ["every"], reach, 1), ["every"], "all"),
    ]
    out = sketch.select(*groups).distinct().withColumn("every", F.lit(1))
    for limits, by, level in levels:
        out = out.join(limits.select(*by, *(F.col(c).alias(f"{level}_{c}") for c in columns)), by, "left")
    return out.select(*groups, *(F.coalesce(*(f"{level}_{c}" for _, _, level in levels)).alias(c) for c in columns))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", reach: float = 3.0, least: int = 20) -> DataFrame:
    """Counts, base_failed and kept for each row."""
    narrow = df.select(name(id_col).alias("doc_id"), name(text_col).alias("text"), name(lang_col).alias("lang"), name(source_col).alias("source"))
    rows = written(measured(narrow, ["doc_id", "lang", "source"]), "quality")
    # null keys meet in the join: a flag and a value instead of a null
    groups = ["lang_null", "lang_key", "source_null", "source_key"]
    keyed = rows.select(
        "*", F.col("lang").isNull().alias("lang_null"), F.coalesce("lang", F.lit("")).alias("lang_key"),
        F.col("source").isNull().alias("source_null"), F.coalesce("source", F.lit("")).alias("source_key"),
    )
    limits = all_fences(sketches(keyed, groups), reach, least)
    # a hot source's rows go to SALT places, and its one row of fences to each of them
    limits = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALT)).cast("int"))
    joined = salted.join(limits, [*groups, "salt"], "left")
    inside = reduce(
        lambda a, b: a & b,
        (F.coalesce((value_of(k) >= F.col(f"low_{k}")) & (value_of(k) <= F.col(f"high_{k}")), F.lit(True)) for k in MEASURES),
    )
    kept = F.when(failed(), False).otherwise(inside)
    return joined.select("doc_id", *_COUNTS, failed().alias("base_failed"), kept.alias("kept"), "lang", "source")
