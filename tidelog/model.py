"""Kinds of records, schemas and errors."""

from __future__ import annotations

#: Kinds of records.
DELETION, VALUE, MERGE, RANGE_DELETION = 0, 1, 2, 3
LOG_SCHEMA = "user_key string, seq long, kind int, value long"
RANGE_SCHEMA = "start_key string, end_key string, rseq long"


class LogError(Exception):
    """Base of all errors."""


class EmptyKey(LogError):
    pass


class InvalidRange(LogError):
    pass


class InvalidScan(LogError):
    pass


class NoMergeOperator(LogError):
    pass


class SnapshotReleased(LogError):
    pass


class Mismatch(LogError):
    """A log opened under other operator names than it was made with."""


class Conflict(LogError):
    """A checked commit whose check failed."""
