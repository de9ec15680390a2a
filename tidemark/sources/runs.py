"""Runs: immutable Parquet file sets, in key order across files and newest first within a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import LOG_COLUMNS, LOG_SCHEMA, OrderError, StoreOptions
from tidemark.operators.compact import Run
from tidemark.operators.stats import check_order, entry_size
from tidemark.sources.files import Files


#: Files of a run up to which the manifest lists their key ranges; beyond it Parquet's own statistics do.
LISTED_FILES = 10_000


#: Entries of a run's file at most, about; what a task sorts, however well they compress.
FILE_ENTRIES = 1 << 20

#: Reads that the files of runs are dealt to at most.
READS = 64


def run_folder() -> Column:
    """The name of a row's run."""
    return F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1)


def file_number() -> Column:
    """The number of a row's file in its run; files go up by key with it."""
    return F.split_part(F.col("_metadata.file_name"), F.lit("-"), F.lit(2)).cast("long")


def write_run(log: DataFrame, files: Files, name: str, level: int, gen: int, options: StoreOptions, bytes_hint: int | None = None, entries_hint: int | None = None) -> Run | None:
    """Write a log as one run, or nothing if it is empty.

    Files hold ranges of (key, seq), so that readers skip by key and a key with very many versions is in several files.
    What is hinted at isn't counted.
    """
    spark = log.sparkSession
    if bytes_hint is None or entries_hint is None:
        entries, size = log.agg(F.count(F.lit(1)), F.sum(entry_size())).first()
        entries_hint, bytes_hint = entries if entries_hint is None else entries_hint, size or 0 if bytes_hint is None else bytes_hint
    parts = max(1, -(-bytes_hint // options.file_bytes), -(-entries_hint // FILE_ENTRIES))
    rows = log.select(*LOG_COLUMNS)
    rows = rows.repartitionByRange(parts, "key", F.desc("seq")) if parts > 1 else rows.coalesce(1)
    writer = rows.sortWithinPartitions("key", F.desc("seq")).write.option("compression", "zstd" if options.compress else "uncompressed")
    writer.option("parquet.bloom.filter.enabled#key", "true").parquet(files.full(name))
    made = read_runs(spark, [files.full(name)])
    if parts > LISTED_FILES:
        count, low, high, seq = made.agg(F.count(F.lit(1)), F.min("key"), F.max("key"), F.max("seq")).first()
        ends = {}
    else:
        count, low, high, seq, ends = _ends(spark, made)
    if not count:
        files.delete(name)
        return None
    listed = tuple(sorted((file, least.hex(), most.hex()) for file, (least, most) in ends.items()))
    return Run(name, level, gen, count, files.size(name), bytes(low), bytes(high), seq, listed)


def _ends(spark: SparkSession, made: DataFrame) -> tuple[int, bytes | None, bytes | None, int | None, dict[str, tuple[bytes, bytes]]]:
    """Rows, least key, largest key and last seq of a new run, and each file's least and largest key: of its first and last row.

    A least key by file would be an aggregate that sorts all rows, as binaries don't fit into a hash aggregate's buffers.
    """
    name = F.col("_metadata.file_name")
    # at most LISTED_FILES rows come to the driver, then two for each
    found = made.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq")).collect()
    if not found:
        return 0, None, None, None, {}
    places = spark.createDataFrame([(f["file"], at) for f in found for at in {0, f["n"] - 1}], "file string, at long")
    rows = made.select("key", name.alias("file"), F.col("_metadata.row_index").alias("at")).join(F.broadcast(places), ["file", "at"])
    keys: dict[str, list[bytes]] = {}
    for row in rows.collect():
        keys.setdefault(row["file"], []).append(bytes(row["key"]))
    ends = {file: (min(k), max(k)) for file, k in keys.items()}
    return sum(f["n"] for f in found), min(e[0] for e in ends.values()), max(e[1] for e in ends.values()), max(f["seq"] for f in found), ends


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(*paths)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files of runs, about one a task, as a union of reads of as many files as there are cores.

    One read of all would put as many into a task as its share of their bytes allows, so that what a task ranks would grow
    with the store. Beyond READS times the cores it does, up to spark.sql.files.maxPartitionBytes.
    """
    at_once = max(1, spark.sparkContext.defaultParallelism, -(-len(paths) // READS))
    return reduce(DataFrame.unionByName, [read_runs(spark, paths[i : i + at_once]) for i in range(0, max(1, len(paths)), at_once)])


def repeats(log: DataFrame) -> DataFrame:
    """The versions, (key, seq), that a log has more than once."""
    return log.groupBy("key", "seq").count().where("count > 1")


def verify_run(spark: SparkSession, path: str) -> None:
    """Raise OrderError unless each file of a run goes up by key and down by seq within a key, without repeats."""
    rows = read_runs(spark, [path])
    if check_order(rows, F.col("_metadata.file_path"), F.col("_metadata.row_index")).first()["violations"] or not repeats(rows).isEmpty():
        raise OrderError("a run must hold each version once, by key and newest first")
