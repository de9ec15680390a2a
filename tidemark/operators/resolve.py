"""Reads of a log as DataFrame plans: newest version per key, tombstones, ranges, snapshots.

All take and return DataFrames and keep extra columns where a row stands for itself. Filters on key and seq come before
the newest version is chosen and reach the Parquet scan; the filter on tombstones comes after, so deleted keys stay deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.model import LOG_COLUMNS, TOMBSTONE, VALUE


#: Seqs of a block of a key's versions in an as-of join.
SEQS_A_BLOCK = 1 << 20


def key_range(log: DataFrame, start=None, end=None) -> DataFrame:
    """Rows with start <= key < end; None is no bound, and a non-null empty end leaves nothing."""
    if start is not None:
        log = log.where(F.col("key") >= F.lit(start))
    if end is not None:
        log = log.where(F.col("key") < F.lit(end))
    return log


def as_of(log: DataFrame, seq: int | None) -> DataFrame:
    return log if seq is None else log.where(F.col("seq") <= seq)


def latest(log: DataFrame, seq: int | None = None) -> DataFrame:
    """The newest version of each key, tombstones included; with seq, of those up to it.

    Ranks are limited to 1 before the shuffle too, so a key with many versions sends one row a task.
    """
    newest = Window.partitionBy("key").orderBy(F.col("seq").desc())
    return as_of(log, seq).withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def visible(newest: DataFrame) -> DataFrame:
    return newest.where(F.col("op") == VALUE)


def tombstones(newest: DataFrame) -> DataFrame:
    return newest.where(F.col("op") == TOMBSTONE)


def scan(log: DataFrame, start=None, end=None, seq: int | None = None, limit: int = 0) -> DataFrame:
    """``key, value`` of live keys in key order; limit 0 is none."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    rows = visible(latest(key_range(log, start, end), seq)).select("key", "value").orderBy("key")
    return rows.limit(limit) if limit else rows


def get(log: DataFrame, key, seq: int | None = None) -> DataFrame:
    """``key, value`` of one key, or no row if it is absent or deleted; an aggregate without a shuffle of rows."""
    newest = as_of(log.where(F.col("key") == F.lit(key)), seq).groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("v"))
    return newest.where(F.col("v.op") == VALUE).select("key", F.col("v.value").alias("value"))


def multi_get(log: DataFrame, keys: DataFrame, seq: int | None = None, cut: bool = True) -> DataFrame:
    """Each row of ``keys`` with ``value`` and ``found``; with ``cut`` the log is cut to the asked keys before versions are ranked."""
    asked = keys.select("key").distinct()
    mine = log.join(asked, "key", "left_semi") if cut else log
    live = visible(latest(mine, seq)).select("key", "value", F.lit(True).alias("found"))
    return keys.join(live, "key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def as_of_join(log: DataFrame, probes: DataFrame, snap: str = "snap", block: int = SEQS_A_BLOCK) -> DataFrame:
    """For each probe (key, snap) the version live at snap: ``key, snap, seq, value``; probes without one give no row.

    Probes and versions of a key are walked once in seq order, so the rows are those of the two inputs and not the
    pairs of them; in blocks of seqs, each with the last version before it, so that a key with very many versions isn't one
    task's. A probe at a version's seq sees it.
    """
    versions = log.select("key", F.col("seq").alias("at"), F.lit(0).alias("probe"), F.struct("seq", "op", "value").alias("version"))
    asked = probes.select("key", F.col(snap).cast("long").alias("at"), F.lit(1).alias("probe"), F.lit(None).cast(versions.schema["version"].dataType).alias("version")).distinct()
    both = versions.unionByName(asked).withColumn("block", F.floor(F.col("at") / block))
    within = Window.partitionBy("key", "block").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy("key", "block").agg(F.max_by("version", F.when(F.col("probe") == 0, F.col("at"))).alias("end"))
    ends = ends.withColumn("earlier", F.last("end", True).over(before)).drop("end")
    inside = both.withColumn("inside", F.last("version", True).over(within)).where("probe = 1")
    found = inside.join(ends, ["key", "block"]).withColumn("seen", F.coalesce("inside", "earlier"))
    return found.where(F.col("seen.op") == VALUE).select("key", F.col("at").alias(snap), F.col("seen.seq").alias("seq"), F.col("seen.value").alias("value"))


def diff(log: DataFrame, older: int | None, newer: int | None) -> DataFrame:
    """Keys whose live value differs between two snapshots: ``key, change, old_value, new_value``.

    Both snapshots come from one pass that groups the log by key.
    """

    def at(seq: int | None) -> Column:
        version = F.struct("op", "value")
        inside = F.lit(True) if seq is None else F.col("seq") <= seq
        return F.max_by(F.when(inside, version), F.when(inside, F.col("seq")))

    both = log.groupBy("key").agg(at(older).alias("a"), at(newer).alias("b"))
    old, new = (F.when(F.col(f"{x}.op") == VALUE, F.col(f"{x}.value")) for x in "ab")
    had, has = (F.coalesce(F.col(f"{x}.op") == VALUE, F.lit(False)) for x in "ab")
    change = F.when(had & ~has, "removed").when(~had & has, "added").when(had & has & ~old.eqNullSafe(new), "changed")
    return both.select("key", change.alias("change"), old.alias("old_value"), new.alias("new_value")).where("change is not null")


def merge_sources(*sources: DataFrame) -> DataFrame:
    """The union of several logs; the order of versions is that of seq, whichever source they are in."""
    return reduce(DataFrame.unionByName, [s.select(*LOG_COLUMNS) for s in sources])
