"""Version garbage collection and the choice of what to compact."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.model import TOMBSTONE, StoreOptions
from tidemark.operators.resolve import latest


def retain(log: DataFrame, keep_seq: int | None, bottommost: bool) -> DataFrame:
    """Versions that a read at ``keep_seq`` or later can see; None: only reads of the newest.

    Of each key all versions above keep_seq stay and the newest one up to it; at the bottommost level a key whose newest
    version is a tombstone up to keep_seq goes altogether. Only versions up to keep_seq are ranked, with the rank limit
    before the shuffle, so a key with very many versions doesn't meet in one task; newer ones are passed through.
    """
    if keep_seq is None:
        newest = latest(log)
        return newest.where(F.col("op") != TOMBSTONE) if bottommost else newest
    recent, seen = log.where(F.col("seq") > keep_seq), latest(log, keep_seq)
    if bottommost:
        written = recent.select("key").distinct().withColumn("_written", F.lit(True))
        seen = seen.join(written, "key", "left").where((F.col("op") != TOMBSTONE) | F.col("_written")).select(*log.columns)
    return recent.unionByName(seen)


def collapse(log: DataFrame, generation: str) -> DataFrame:
    """The newest version of each key within each generation, as a flush of one writes it."""
    newest = Window.partitionBy(generation, "key").orderBy(F.col("seq").desc())
    return log.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


@dataclass(frozen=True)
class Run:
    """A sorted, immutable file set."""

    path: str
    level: int
    gen: int
    num_entries: int
    size_bytes: int
    min_key: bytes
    max_key: bytes
    max_seq: int
    #: (name, least key, largest key) of each file, keys in hexadecimal; none if there are too many to list.
    files: tuple[tuple[str, str, str], ...] = ()

    def paths(self, start: bytes | None, end: bytes | None) -> list[str]:
        """The files that may hold keys from start up to, without, end."""
        if not self.overlaps(start, end):
            return []
        if not self.files:
            return [self.path]
        low, high = (None if k is None else k.hex() for k in (start, end))
        return [f"{self.path}/{name}" for name, least, most in self.files if (low is None or most >= low) and (high is None or least < high)]

    def overlaps(self, start: bytes | None, end: bytes | None) -> bool:
        return (start is None or self.max_key >= start) and (end is None or self.min_key < end)


@dataclass(frozen=True)
class Plan:
    inputs: tuple[Run, ...]
    target: int


def level_target(level: int, options: StoreOptions) -> int:
    return options.base_level_bytes * options.level_multiplier ** (level - 1)


def pick(runs: Iterable[Run], options: StoreOptions) -> Plan | None:
    """All of level 0 and 1 if level 0 has enough runs, else the first level above its target with the next one."""
    by_level: dict[int, list[Run]] = {}
    for run in runs:
        by_level.setdefault(run.level, []).append(run)
    if len(by_level.get(0, [])) >= options.l0_trigger:
        return Plan((*by_level[0], *by_level.get(1, [])), 1)
    for level in range(1, options.max_levels - 1):
        if sum(r.size_bytes for r in by_level.get(level, [])) > level_target(level, options):
            return Plan((*by_level[level], *by_level.get(level + 1, [])), level + 1)
    return None


def is_bottommost(runs: Iterable[Run], target: int) -> bool:
    return all(run.level <= target for run in runs)
