"""Structured Streaming into a store, and views of a log as a stream."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.model import VALUE
from tidemark.plans.store import Store
from tidemark.sources.files import Files


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps over restarts from its checkpoint."""
    return json.loads(Files(spark, checkpoint).read("metadata"))["id"]


def ingest(store: Store, mutations: DataFrame, order_by: str | Column, checkpoint: str, name: str = "ingest", once: bool = True) -> StreamingQuery:
    """Write a stream of (key, op, value) to a store, each micro-batch once.

    The store's manifest holds the last batch of each stream, by the id that its checkpoint gives it; a batch that is run
    again after a crash is left out, so its rows keep the seqs that they got first. A new checkpoint is a new stream,
    whatever its name. Rates are those of the source (maxFilesPerTrigger and the like).
    """

    def write(batch: DataFrame, number: int) -> None:
        store.apply(batch, order_by, (stream_id(store.spark, checkpoint), number))

    writer = mutations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_counts(mutations: DataFrame, time: str, late: str, window: str) -> DataFrame:
    """Puts and deletes by event-time window, with a watermark for late rows."""
    kind = F.col("op") == VALUE
    timed = mutations.withWatermark(time, late).groupBy(F.window(time, window))
    return timed.agg(F.count(F.when(kind, 1)).alias("puts"), F.count(F.when(~kind, 1)).alias("deletes"))
