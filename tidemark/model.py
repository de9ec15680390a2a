"""The log's schema, options and errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

VALUE, TOMBSTONE = 1, 2

LOG_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.IntegerType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.fieldNames()


class StoreError(Exception):
    """Any error of the store."""


class NotFoundError(StoreError):
    def __init__(self) -> None:
        super().__init__("key not found")


class EmptyKeyError(StoreError):
    def __init__(self) -> None:
        super().__init__("key must not be empty")


class ClosedError(StoreError):
    def __init__(self) -> None:
        super().__init__("store is closed")


class OrderError(StoreError):
    """A run isn't sorted by key, then from new to old, or repeats a version."""


class ConflictError(StoreError):
    """Another writer committed first."""


class CorruptLogError(StoreError):
    """A log record of a kind that doesn't exist."""


@dataclass(frozen=True)
class StoreOptions:
    """Thresholds of flushing and levelled compaction."""

    flush_threshold: int = 4 << 20
    l0_trigger: int = 4
    base_level_bytes: int = 2 << 20
    level_multiplier: int = 10
    max_levels: int = 7
    compress: bool = False
    #: Keep logs whose records are in runs, in wal/kept, for read_wal; otherwise a flush deletes them.
    keep_logs: bool = False
    #: Bytes of a run's files, so that a large run is many files in key order.
    file_bytes: int = 256 << 20


def check_key(key: bytes | None) -> bytes:
    if not key:
        raise EmptyKeyError
    return bytes(key)
