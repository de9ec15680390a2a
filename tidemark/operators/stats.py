"""Aggregates over logs and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.model import TOMBSTONE, StoreOptions

#: Upper bounds of the latency buckets, in seconds.
LATENCY_BOUNDS = (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)
#: Bytes that an entry takes in memory besides its key and value.
ENTRY_OVERHEAD = 48
#: Places of a run that are walked as one in an order check.
PLACES_A_BLOCK = 1 << 18


def run_stats(log: DataFrame, run: str) -> DataFrame:
    """Entries, tombstones and key range of each run."""
    return log.groupBy(run).agg(
        F.count(F.lit(1)).alias("num_entries"),
        F.count(F.when(F.col("op") == TOMBSTONE, 1)).alias("num_tombstones"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.max("seq").alias("max_seq"),
    )


def check_order(log: DataFrame, run: str | Column, place: str | Column, file: str | Column | None = None, block: int = PLACES_A_BLOCK) -> DataFrame:
    """Rows, runs, and rows that don't come after the row placed before them in their run: by key, then from new to old.

    Places are numbers, of a file's rows if there is ``file``; files of a run follow each other in its order. A run is
    walked in blocks of places, and a block's first row is held against the last one before it, so no task has a whole run.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    placed = log.select("key", "seq", col(run).alias("_run"), (F.lit(0) if file is None else col(file)).alias("_file"), col(place).alias("_place"))
    blocks = placed.withColumn("_block", F.floor(F.col("_place") / block))

    def late(key: str, seq: str, last_key: str, last_seq: str) -> Column:
        return (F.col(key) < F.col(last_key)) | ((F.col(key) == F.col(last_key)) & (F.col(seq) >= F.col(last_seq)))

    walk, across = Window.partitionBy("_run", "_file", "_block").orderBy("_place"), Window.partitionBy("_run").orderBy("_file", "_block")
    step = blocks.withColumns({"_key": F.lag("key").over(walk), "_seq": F.lag("seq").over(walk)})
    # a block's rows come in order, so its first and last are found without another sort
    version = F.struct("key", "seq")
    ends = step.groupBy("_run", "_file", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(late("key", "seq", "_key", "_seq"), 1)).alias("late"), F.min_by(version, "_place").alias("first"), F.max_by(version, "_place").alias("last")
    )
    held = ends.withColumn("before", F.lag("last").over(across))
    first = F.when(late("first.key", "first.seq", "before.key", "before.seq"), 1).otherwise(0)
    zero = F.lit(0).cast("long")
    return held.agg(F.coalesce(F.sum("n"), zero).alias("num_rows"), F.countDistinct("_run").alias("num_runs"), F.coalesce(F.sum(F.col("late") + first), zero).alias("violations"))


def entry_size() -> Column:
    return (F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + ENTRY_OVERHEAD).cast("long")


def size_estimate(log: DataFrame) -> DataFrame:
    """Bytes that each key's mutations add to a memory table; overwrites don't give bytes back."""
    return log.groupBy("key").agg(F.sum(entry_size()).alias("size_bytes"))


def distinct_keys(log: DataFrame) -> DataFrame:
    return log.agg(F.countDistinct("key").alias("num_keys"))


def level_layout(spark: SparkSession, runs: DataFrame, options: StoreOptions) -> DataFrame:
    """A row a level, empty ones too: runs, bytes, target and whether it is due for compaction; runs: level, size_bytes."""
    sums = runs.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))
    spine = spark.range(options.max_levels).select(F.col("id").cast("int").alias("level"))
    target = F.when(F.col("level") > 0, (F.lit(options.base_level_bytes) * F.pow(F.lit(options.level_multiplier), F.col("level") - 1)).cast("long"))
    n, size = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("bytes", F.lit(0)).cast("long")
    due = F.when(F.col("level") == 0, n >= options.l0_trigger).otherwise((F.col("level") < options.max_levels - 1) & (size > target))
    # sums has as many rows as there are levels at most
    return spine.join(F.broadcast(sums), "level", "left").select("level", n.alias("num_runs"), size.alias("size_bytes"), target.alias("target_bytes"), due.alias("needs_compaction"))


def tables_per_level(layout: DataFrame) -> DataFrame:
    """One row: total runs and their number by level as an array."""
    return layout.agg(F.sum("num_runs").alias("num_runs"), F.transform(F.sort_array(F.collect_list(F.struct("level", "num_runs"))), lambda x: x["num_runs"]).alias("per_level"))


def histogram(values: DataFrame, column: str, bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """``le, n``: cumulative counts up to each bound and to +Inf, negatives as 0, from one pass; nulls don't count."""
    value = F.when(F.col(column) < 0, 0).otherwise(F.col(column))
    counts = values.agg(*[F.count(F.when(value <= b, 1)).alias(f"c{i}") for i, b in enumerate(bounds)], F.count(column).alias("all"))
    rows = [F.struct(F.lit(repr(b)).alias("le"), F.col(f"c{i}").alias("n")) for i, b in enumerate(bounds)]
    return counts.select(F.inline(F.array(*rows, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))))
