"""Where operators keep intermediate tables that every executor can read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import slices

_NAME = "tidemark_"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is set only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; results made before can't be read any more."""
    for table in spark.catalog.listTables():
        if table.name.startswith(_NAME):
            spark.sql(f"drop table if exists {table.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def steady(df: DataFrame) -> DataFrame:
    """df, written first if it comes out of a shuffle: tasks that run again then see rows in the same order and number them alike."""
    return stored(df) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def stored_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """As stored(), clustered into ``parts`` buckets of ``key``, or as many as Spark allows: later grouping or joining by
    key doesn't shuffle it."""
    spark = df.sparkSession
    parts = min(parts, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    name = f"{_NAME}{uuid.uuid4().hex}"
    path = f"{session_dir(spark)}/{name}"
    df.repartition(parts, key).write.option("path", path).option("compression", "zstd").bucketBy(parts, key).saveAsTable(name)
    return spark.table(name)


#: Bytes of an Arrow batch that a Python task gets at once.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with batches of at most BATCH_BYTES, which it sets for the session, so that tasks hold a few MB."""
    df.sparkSession.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def add_columns(docs: DataFrame, source: str, added: str, work: Callable[[list], list[pa.Array]], cut=slices) -> DataFrame:
    """Each row with the columns that ``added`` declares, which replace columns of the same names.

    ``work`` gets the values of ``source`` of a slice of rows, as ``cut`` yields them with the slice's first row, and
    returns the added columns of the slice.
    """
    new = T.StructType.fromDDL(added)
    fields = [f for f in docs.schema.fields if f.name.lower() not in {a.name for a in new.fields}]
    where = [f.name for f in fields].index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values in cut(batch.column(where)):
                columns = work(values)
                part = batch.slice(row, len(columns[0]))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *new.names])

    return map_batches(docs.select(*[F.col(f"`{f.name}`") for f in fields]), run, T.StructType([*fields, *new.fields]))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, for sizing chunks and buckets."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
