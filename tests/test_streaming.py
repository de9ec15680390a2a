from pyspark.sql import functions as F

from tests.logs import rows
from tidemark.plans.store import Store
from tidemark.streaming.ingest import ingest, live_counts, stream_id

SCHEMA = "i long, key string, value string, op int"


def source(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(path).select("i", F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"), "op")


def add(spark, path, items):
    spark.createDataFrame(items, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_ingest_writes_each_batch_once(spark, tmp_path):
    path, checkpoint = f"{tmp_path}/in", f"{tmp_path}/checkpoint"
    store = Store(spark, f"{tmp_path}/store")
    add(spark, path, [(1, "a", "1", 1), (2, "b", "1", 1)])
    ingest(store, source(spark, path), "i", checkpoint).awaitTermination()
    add(spark, path, [(3, "a", "2", 1), (4, "b", None, 2)])
    ingest(store, source(spark, path), "i", checkpoint).awaitTermination()
    assert rows(store.scan()) == [(b"a", b"2")]
    n = store.log().count()
    # the same batch number again, as after a crash between the store's commit and the checkpoint's
    stream = stream_id(spark, checkpoint)
    assert not store.apply(spark.createDataFrame([(b"a", 1, b"x", 9)], "key binary, op int, value binary, i long"), "i", (stream, 1))
    assert store.log().count() == n and rows(store.scan()) == [(b"a", b"2")]
    store.close()
    with Store(spark, f"{tmp_path}/store") as again:
        assert again._manifest.batches == {stream: 1}


def test_streams_of_the_same_name(spark, tmp_path):
    """What tells streams apart is their checkpoint."""
    with Store(spark, f"{tmp_path}/store") as store:
        for i, items in enumerate([[(1, "a", "1", 1)], [(1, "b", "1", 1), (2, "c", "1", 1)]]):
            add(spark, f"{tmp_path}/in{i}", items)
            ingest(store, source(spark, f"{tmp_path}/in{i}"), "i", f"{tmp_path}/checkpoint{i}").awaitTermination()
        assert [k for k, _ in rows(store.scan())] == [b"a", b"b", b"c"]


def test_windowed_counts(spark, tmp_path):
    path = f"{tmp_path}/in"
    spark.sql("select timestamp'2024-01-01 00:00:01' as t, 1 as op union all select timestamp'2024-01-01 00:00:02', 2 union all select timestamp'2024-01-01 00:01:30', 1").write.parquet(path)
    stream = spark.readStream.schema("t timestamp, op int").parquet(path)
    query = live_counts(stream, "t", "10 seconds", "1 minute").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.puts, r.deletes) for r in spark.table("counts").collect()) == [(1, 0), (1, 1)]
