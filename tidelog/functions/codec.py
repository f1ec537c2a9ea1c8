"""Encodings as columns: keys with their numbers, integers, shared prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def fixed64(x: Column) -> Column:
    """Eight bytes, big end first."""
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def internal_key(user_key: Column, seq: Column, kind: Column) -> Column:
    """The key, then its number and kind in one big-endian word."""
    return F.concat(F.encode(user_key, "UTF-8"), fixed64(F.shiftleft(seq, 8).bitwiseOR(kind.cast("long"))))


def user_key_of(key: Column) -> Column:
    return F.decode(F.substring(key, F.lit(1), F.length(key) - 8), "UTF-8")


def trailer_of(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, F.length(key) - 7, F.lit(8))), 16, 10).cast("decimal(20,0)")


def seq_of(key: Column) -> Column:
    return F.floor(trailer_of(key) / 256).cast("long")


def kind_of(key: Column) -> Column:
    return (trailer_of(key) % 256).cast("int")


def uvarint_length(x: Column) -> Column:
    """Bytes of an unsigned varint: seven bits in each."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("int")


def uvarint(x: Column) -> Column:
    """The varint itself, low bits first."""
    n = uvarint_length(x)
    parts = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.lpad(F.hex(F.pmod(F.floor(x / F.pow(F.lit(128.0), i)).cast("long"), F.lit(128)) + F.when(i < n - 1, 128).otherwise(0)), 2, "0"),
    )
    return F.unhex(F.array_join(parts, ""))


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two strings share."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(same)
