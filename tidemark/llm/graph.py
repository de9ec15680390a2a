"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, root``: the least id that each linked id can be reached from. Null ids are no links.

    Labels take the least label among the neighbours and then their label's label, until nothing changes; the table is
    stored after each round. A hot id is reduced before the shuffle, and as a join key it is split by AQE.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi")
    least = pairs.groupBy("hi").agg(F.min("lo").alias("top"))
    # an id's smaller neighbours are tied to the least of them instead of to it
    tied = pairs.join(least, "hi").where("lo <> top").select(F.col("top").alias("lo"), F.col("lo").alias("hi"))
    pairs = least.select(F.col("top").alias("lo"), "hi").unionByName(tied).distinct()
    edges = stored(pairs.select(F.col("lo").alias("s"), F.col("hi").alias("t")).unionAll(pairs.select("hi", "lo")))
    labels = stored(edges.groupBy(F.col("s").alias("id")).agg(F.min(F.least("s", "t")).alias("root")))
    while True:
        near = edges.join(labels, F.col("t") == F.col("id")).groupBy("s").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("id") == F.col("s")).select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("id").alias("via"), F.col("root").alias("top"))
        step = stored(step.join(up, F.col("root") == F.col("via")).select("id", "old", F.least("root", "top").alias("root")))
        labels = step.select("id", "root")
        if step.where("root <> old").isEmpty():
            return labels
