"""Reads of a resolved view: points, batches, ranges, prefixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import EmptyKey, InvalidScan


def get(view: DataFrame, key: str) -> DataFrame:
    if not key:
        raise EmptyKey
    return view.where(F.col("user_key") == key)


def multi_get(view: DataFrame, keys: DataFrame, errors: bool = False) -> DataFrame:
    """``keys`` (idx, user_key) with seq and value; null where a key is missing.

    ``errors``: adds error, the name of what is wrong with a key of its own (null or empty), so that one bad key fails its slot only."""
    found = keys.join(view, "user_key", "left").select("idx", "user_key", "seq", "value")
    return found.withColumn("error", F.when(F.coalesce(F.length("user_key"), F.lit(0)) == 0, EmptyKey.__name__)) if errors else found


def get_for_update(view: DataFrame, keys: DataFrame) -> DataFrame:
    """As ``multi_get``; the seq of a missing key is 0."""
    return multi_get(view, keys).withColumn("seq", F.coalesce("seq", F.lit(0)))


def successor(prefix: str) -> str | None:
    """The least string after all that begin with ``prefix``; None if there is none."""
    trimmed = prefix.rstrip(chr(0x10FFFF))
    if not trimmed:
        return None
    after = ord(trimmed[-1]) + 1
    return trimmed[:-1] + chr(0xE000 if after == 0xD800 else after)  # surrogates are no characters


def _bytewise(c: Column) -> Column:
    return c


def scan(view: DataFrame, lower: str | None = None, upper: str | None = None, prefix: str | None = None, order: Callable[[Column], Column] = _bytewise) -> DataFrame:
    """The keys from ``lower`` up to, not with, ``upper``, or those that begin with ``prefix``.

    ``order``: from a key to what it is compared by; keys themselves by default, in which case bounds reach the scan of the table."""
    if prefix and (lower is not None or upper is not None):
        raise InvalidScan
    if prefix:
        view = view.where(F.col("user_key").startswith(prefix))
    if lower is not None:
        view = view.where(order(F.col("user_key")) >= order(F.lit(lower)))
    if upper is not None:
        view = view.where(order(F.col("user_key")) < order(F.lit(upper)))
    return view


def seek(view: DataFrame, target: str, lower: str | None = None, upper: str | None = None, order: Callable[[Column], Column] = _bytewise) -> DataFrame:
    """The first key at or after ``target`` within the bounds."""
    within = scan(scan(view, target, upper, order=order), lower, order=order)
    return within.orderBy(order(F.col("user_key")), "user_key").limit(1)
