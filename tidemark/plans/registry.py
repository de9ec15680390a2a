"""Queries of the versioned-log engine over the sample tables, and the SQL that gives the same rows.

``events`` is the main log: a user's id is the key, the event number the seq, an error event deletes. Keys and values are
text here, so that both sides can print them; the operators take binary the same.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.codec import base64_line, int_key, text_key
from tidemark.model import TOMBSTONE, VALUE, NotFoundError, StoreError, StoreOptions
from tidemark.operators import compact, resolve, stats
from tidemark.plans.store import Store
from tidemark.sources.files import Files
from tidemark.sources.runs import file_number, read_runs, run_folder, write_run
from tidemark.sources.wal import read_wal

GEN_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    deleted = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.format_string("u%08d", "user_id").alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(deleted, TOMBSTONE).otherwise(VALUE).alias("op"),
        F.when(~deleted, F.col("props")).alias("value"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    deleted = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(
        F.format_string("c%08d", "o_custkey").alias("key"),
        (F.col("o_orderkey") + 1).alias("seq"),
        F.when(deleted, TOMBSTONE).otherwise(VALUE).alias("op"),
        F.when(~deleted, F.col("o_orderpriority")).alias("value"),
    )


def generations(log: DataFrame, rows: int = GEN_ROWS) -> DataFrame:
    return log.withColumn("gen", F.floor((F.col("seq") - 1) / rows))


EVENTS = """log as (select printf('u%08d', user_id) as key, event_id + 1 as seq,
  case when event_type = 'error' then 2 else 1 end as op, case when event_type = 'error' then null else props end as value
  from events)"""
ORDERS = """log as (select printf('c%08d', o_custkey) as key, o_orderkey + 1 as seq,
  case when o_orderstatus = 'F' then 2 else 1 end as op, case when o_orderstatus = 'F' then null else o_orderpriority end as value
  from orders)"""


def _latest(name: str, where: str = "true") -> str:
    return f"{name} as (select key, seq, op, value from (select *, row_number() over (partition by key order by seq desc) as rn from log where {where}) where rn = 1)"


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scan(events_log(spark, sf_dir))


def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.get(events_log(spark, sf_dir), "u00000007")


def point_get_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.get(events_log(spark, sf_dir), "u00000012", 5000)


def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.format_string("u%08d", "c_custkey").alias("key"))
    return resolve.multi_get(events_log(spark, sf_dir), keys)


def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scan(events_log(spark, sf_dir))


def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scan(events_log(spark, sf_dir), "u00000010", "u00000060")


def range_scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scan(events_log(spark, sf_dir), "u00000010", limit=20)


def empty_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows ranges without keys have: up to the empty key, from a key to itself, and from a key to a lesser one."""
    log = events_log(spark, sf_dir)
    bounds = [(None, ""), ("u00000010", "u00000010"), ("u00000060", "u00000010")]
    return reduce(DataFrame.unionByName, [resolve.scan(log, *b).agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("num_rows")) for i, b in enumerate(bounds)])


def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scan(events_log(spark, sf_dir), seq=5000)


def orders_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scan(orders_log(spark, sf_dir))


def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    probes = log.select("key").distinct().select("key", F.explode(F.array(*map(F.lit, (10, 2500, 5000, 9999)))).alias("snap"))
    return resolve.as_of_join(log, probes)


def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    return resolve.scan(resolve.merge_sources(log.where("seq > 7000"), log.where("seq <= 3000"), log.where("seq > 3000 and seq <= 7000")))


def compact_retain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.retain(events_log(spark, sf_dir), 5000, True)


def compact_retain_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.retain(events_log(spark, sf_dir), 9990, False)


def compact_retain_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.retain(events_log(spark, sf_dir), 9990, True)


def compact_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.retain(events_log(spark, sf_dir), None, True)


def flush_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.collapse(generations(events_log(spark, sf_dir)), "gen")


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.run_stats(generations(events_log(spark, sf_dir)), "gen")


def order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they come are no valid runs: how many are out of order in their generation."""
    return stats.check_order(generations(events_log(spark, sf_dir)), "gen", "seq")


def run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a run are in order, by its files and the places that the rows have in them."""
    files = Files(spark, _folder(spark))
    write_run(binary(events_log(spark, sf_dir)), files, "run", 0, 1, StoreOptions())
    return stats.check_order(read_runs(spark, [files.full("run")]), run_folder(), F.col("_metadata.row_index"), file_number())


def size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.size_estimate(events_log(spark, sf_dir))


def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distinct_keys(events_log(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = generations(events_log(spark, sf_dir), 500).withColumn("size", stats.entry_size()).groupBy("gen").agg(F.sum("size").alias("size_bytes"))
    return runs.select(F.when(F.col("gen") >= 16, 0).when(F.col("gen") >= 12, 1).otherwise(2).alias("level"), "size_bytes")


def level_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.level_layout(spark, _runs(spark, sf_dir), StoreOptions(base_level_bytes=2000))


def tables_per_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.tables_per_level(stats.level_layout(spark, _runs(spark, sf_dir), StoreOptions(base_level_bytes=2000)))
    return counts.withColumn("per_level", F.array_join(F.col("per_level").cast("array<string>"), ","))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "events").select((F.col("value") / 100).alias("seconds")), "seconds")


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.diff(events_log(spark, sf_dir), 5000, None)


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.tombstones(resolve.latest(events_log(spark, sf_dir)))


def _folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise StoreError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="tidemark-")
    return f"{named}/stores/{uuid.uuid4().hex}"


def binary(log: DataFrame) -> DataFrame:
    return log.withColumn("key", text_key("key")).withColumn("value", F.encode("value", "UTF-8"))


def text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.decode(c, "UTF-8") for c in ("key", "value")})


def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written to a store in two batches, compacted, reopened and scanned."""
    log, folder = binary(events_log(spark, sf_dir)), _folder(spark)
    with Store(spark, folder) as store:
        store.apply(log.where("seq <= 5000"), "seq")
        store.apply(log.where("seq > 5000"), "seq")
        store.compact()
    return text(Store(spark, folder, read_only=True).scan())


def store_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of a batch, with the seq that the store gave it."""
    store = Store(spark, _folder(spark))
    store.apply(binary(events_log(spark, sf_dir)), "seq")
    return text(store.log())


def store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot between two batches, read after the second one, a compaction and a vacuum."""
    log, store = binary(events_log(spark, sf_dir)), Store(spark, _folder(spark))
    store.apply(log.where("seq <= 5000"), "seq")
    snapshot = store.snapshot()
    store.apply(log.where("seq > 5000"), "seq")
    store.compact()
    store.vacuum()
    return text(snapshot.scan())


def store_pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a compaction keeps of each key while a snapshot is open: all later versions and the one that it sees."""
    log, store = binary(events_log(spark, sf_dir)), Store(spark, _folder(spark))
    store.apply(log.where("seq <= 5000"), "seq")
    store.snapshot()
    store.apply(log.where("seq > 5000"), "seq")
    store.compact()
    return text(store.log())


def store_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches under small thresholds move down the levels; all keys stay readable."""
    log = binary(events_log(spark, sf_dir))
    store = Store(spark, _folder(spark), StoreOptions(l0_trigger=2, base_level_bytes=2000, max_levels=4, file_bytes=1 << 20))
    last = log.agg(F.max("seq")).first()[0] or 0
    for i in range(5):
        store.apply(log.where(F.col("seq").between(last * i // 5 + 1, last * (i + 1) // 5)), "seq")
    deep = sum(store.stats()["runs_per_level"][1:]) > 0
    return text(store.scan()).withColumn("deep", F.lit(deep))


def store_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions that are left when nothing is pinned and all runs are compacted to the bottom: no tombstones."""
    store = Store(spark, _folder(spark))
    store.apply(binary(events_log(spark, sf_dir)), "seq")
    store.compact()
    store.vacuum()
    return text(store.log())


def reopen_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed store that is opened again, uncompressed: customers' keys get a new value, suppliers' keys go."""
    folder = _folder(spark)
    with Store(spark, folder, StoreOptions(compress=True)) as store:
        store.apply(binary(events_log(spark, sf_dir)), "seq")
    with Store(spark, folder) as store:
        store.put_all(table(spark, sf_dir, "customer").select("c_custkey", int_key("c_custkey", "u", 8).alias("key"), F.encode("c_mktsegment", "UTF-8").alias("value")), "c_custkey")
        store.delete_all(table(spark, sf_dir, "supplier").select("s_suppkey", int_key("s_suppkey", "u", 8).alias("key")), "s_suppkey")
    return text(Store(spark, folder, read_only=True).scan())


def store_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(int_key("c_custkey", "u", 8).alias("key"))
    store = Store(spark, _folder(spark))
    store.apply(binary(events_log(spark, sf_dir)), "seq")
    return text(store.multi_get(keys))


def _single_writes(spark: SparkSession, sf_dir: str, store: Store) -> None:
    """Each supplier put, and those in debt deleted again, by single calls through the write-ahead log."""
    for row in table(spark, sf_dir, "supplier").orderBy("s_suppkey").toLocalIterator():
        store.put(row["s_name"].encode(), f"{row['s_nationkey']}".encode())
        if row["s_acctbal"] < 0:
            store.delete(row["s_name"].encode())


def store_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single writes of a store that was never closed, after the next one has opened its folder."""
    folder = _folder(spark)
    _single_writes(spark, sf_dir, Store(spark, folder))
    return text(Store(spark, folder).scan())


def torn_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with half a record at the end of the log."""
    folder = _folder(spark)
    _single_writes(spark, sf_dir, Store(spark, folder))
    files = Files(spark, folder)
    for name in files.names("wal"):
        files.write(f"wal/{name}", files.read(f"wal/{name}") + bytes.fromhex("deadbeef0102"))
    return text(Store(spark, folder).scan())


def wal_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log files of single writes as a table, those of writes that were flushed meanwhile too."""
    folder = _folder(spark)
    _single_writes(spark, sf_dir, Store(spark, folder, StoreOptions(keep_logs=True)))
    return text(read_wal(spark, f"{folder}/wal"))


def binary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of one- and two-byte keys, 0x00 and 0xFF among them, in unsigned order; keys and values in hexadecimal."""
    byte = F.format_string("%02X", (F.col("event_id") * 37) % 256)
    key = F.when(F.col("event_id") % 5 == 0, byte).when(F.col("event_id") % 2 == 0, F.concat(byte, F.lit("00"))).otherwise(F.concat(byte, F.lit("FF")))
    rows = table(spark, sf_dir, "events").select("event_id", F.unhex(key).alias("key"), F.unhex(byte).alias("value"))
    store = Store(spark, _folder(spark))
    store.put_all(rows, "event_id")
    return store.scan(b"\x00\x00", b"\xff\x00").select(F.hex("key").alias("key"), F.hex("value").alias("value"))


def base64_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scan(events_log(spark, sf_dir)).select("key", base64_line(F.encode("value", "UTF-8")).alias("value"))


def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that a store writes out after a batch, a get of each region's name and a scan."""
    store = Store(spark, _folder(spark))
    store.apply(binary(events_log(spark, sf_dir)), "seq")
    store.put(b"EUROPE", b"1")
    for row in table(spark, sf_dir, "region").collect():
        try:
            store.get(row["r_name"].encode())
        except NotFoundError:
            pass
    store.scan()
    lines = [line.split(" ") for line in store.render_metrics().splitlines() if not line.startswith("#")]
    wanted = ("puts_total", "deletes_total", "gets_total", "get_hits_total", "get_misses_total", "scans_total", "active_snapshots", "memtable_entries", "get_duration_seconds_count")
    return spark.createDataFrame([(name, int(value)) for name, value in lines if name.removeprefix("tidemark_") in wanted], "name string, value long")


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts and deletes by hour, from a stream."""
    from tidemark.streaming.ingest import live_counts

    timed = _event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("t"), F.when(F.col("event_type") == "error", TOMBSTONE).otherwise(VALUE).alias("op"))
    folder = _folder(spark)
    stream = live_counts(timed, "t", "1 hour", "1 hour").writeStream.outputMode("complete").option("checkpointLocation", f"{folder}-stream")
    stream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(folder)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "puts", "deletes")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/event[s].parquet")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events streamed into a store, then scanned."""
    from tidemark.streaming.ingest import ingest

    deleted = F.col("event_type") == "error"
    rows = _event_stream(spark, sf_dir).select(int_key("user_id", "u", 8).alias("key"), F.when(deleted, TOMBSTONE).otherwise(VALUE).alias("op"), F.encode("props", "UTF-8").alias("value"), "event_id")
    folder = _folder(spark)
    store = Store(spark, folder)
    ingest(store, rows, "event_id", f"{folder}-stream").awaitTermination()
    return text(store.scan())


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


_SCAN = f"with {EVENTS}, {_latest('newest')} select key, value from newest where op = 1"
_SUPPLIERS = "select s_name as key, s_nationkey::varchar as value from supplier where s_acctbal >= 0"
_BOUNDS = ", ".join(f"('{b!r}', {b!r}::double)" for b in stats.LATENCY_BOUNDS)
_LAYOUT = f"""with {EVENTS}, run as (
  select (seq - 1) // 500 as gen, sum(strlen(key) + coalesce(strlen(value), 0) + 48) as bytes from log group by 1),
placed as (select case when gen >= 16 then 0 when gen >= 12 then 1 else 2 end as level, bytes from run),
layout as (select s.level::integer as level, count(p.level)::bigint as num_runs, coalesce(sum(p.bytes), 0)::bigint as size_bytes,
  case when s.level > 0 then (2000 * power(10, s.level - 1))::bigint end as target_bytes,
  case when s.level = 0 then count(p.level) >= 4
    else s.level < 6 and coalesce(sum(p.bytes), 0) > 2000 * power(10, s.level - 1) end as needs_compaction
  from range(7) s(level) left join placed p on s.level = p.level group by s.level)"""


def _retain(seq: int, bottommost: bool) -> str:
    rule = f"and not (op = 2 and seq <= {seq} and seq = newest)" if bottommost else ""
    return f"""with {EVENTS}, seen as (select *, max(case when seq <= {seq} then seq end) over (partition by key) as seen,
      max(seq) over (partition by key) as newest from log)
    select key, seq, op, value from seen where (seq > {seq} or seq = seen) {rule}"""


_QUERIES = {
    point_get: f"with {EVENTS}, {_latest('newest')} select key, value from newest where op = 1 and key = 'u00000007'",
    point_get_as_of: f"with {EVENTS}, {_latest('newest', 'seq <= 5000')} select key, value from newest where op = 1 and key = 'u00000012'",
    multi_get: f"""with {EVENTS}, {_latest('newest')}, asked as (select printf('u%08d', c_custkey) as key from customer)
      select a.key, n.value, n.key is not null as found from asked a left join (select * from newest where op = 1) n on a.key = n.key""",
    full_scan: _SCAN,
    range_scan: f"{_SCAN} and key >= 'u00000010' and key < 'u00000060'",
    range_scan_limit: f"{_SCAN} and key >= 'u00000010' order by key limit 20",
    empty_range: "select i::integer as i, 0::bigint as num_rows from range(3) r(i)",
    snapshot_scan: f"with {EVENTS}, {_latest('newest', 'seq <= 5000')} select key, value from newest where op = 1",
    orders_scan: f"with {ORDERS}, {_latest('newest')} select key, value from newest where op = 1",
    as_of_join: f"""with {EVENTS}, probe as (select distinct key, snap from log, (values (10), (2500), (5000), (9999)) s(snap)),
      found as (select p.key, p.snap, l.seq, l.op, l.value, row_number() over (partition by p.key, p.snap order by l.seq desc) as rn
        from probe p join log l on p.key = l.key and l.seq <= p.snap)
      select key, snap::bigint as snap, seq, value from found where rn = 1 and op = 1""",
    merge_union: _SCAN,
    compact_retain: _retain(5000, True),
    compact_retain_upper: _retain(9990, False),
    compact_retain_late: _retain(9990, True),
    compact_full: f"with {EVENTS}, {_latest('newest')} select key, seq, op, value from newest where op <> 2",
    flush_collapse: f"""with {EVENTS}, ranked as (select *, (seq - 1) // 1000 as gen,
        row_number() over (partition by (seq - 1) // 1000, key order by seq desc) as rn from log)
      select key, seq, op, value, gen from ranked where rn = 1""",
    run_stats: f"""with {EVENTS} select (seq - 1) // 1000 as gen, count(*) as num_entries, count(*) filter (op = 2) as num_tombstones,
      min(key) as min_key, max(key) as max_key, max(seq) as max_seq from log group by 1""",
    order_check: f"""with {EVENTS}, walk as (select (seq - 1) // 1000 as gen, key, lag(key) over (partition by (seq - 1) // 1000 order by seq) as before from log)
      select count(*) as num_rows, count(distinct gen) as num_runs, count(*) filter (key <= before) as violations from walk""",
    run_order: f"with {EVENTS} select count(*) as num_rows, 1::bigint as num_runs, 0::bigint as violations from log",
    size_estimate: f"with {EVENTS} select key, sum(strlen(key) + coalesce(strlen(value), 0) + 48)::bigint as size_bytes from log group by key",
    distinct_keys: f"with {EVENTS} select count(distinct key) as num_keys from log",
    level_layout: f"{_LAYOUT} select * from layout",
    tables_per_level: f"{_LAYOUT} select sum(num_runs)::bigint as num_runs, array_to_string(list(num_runs order by level), ',') as per_level from layout",
    latency_histogram: f"""select le, count(*) filter (e.value / 100 <= bound) as n from events e, (values {_BOUNDS}) b(le, bound) group by le
      union all select '+Inf', count(value) from events""",
    snapshot_diff: f"""with {EVENTS}, {_latest('old', 'seq <= 5000')}, {_latest('new')},
      a as (select key, value from old where op = 1), b as (select key, value from new where op = 1)
      select coalesce(a.key, b.key) as key, case when b.key is null then 'removed' when a.key is null then 'added' else 'changed' end as change,
        a.value as old_value, b.value as new_value
      from a full join b on a.key = b.key where a.key is null or b.key is null or a.value is distinct from b.value""",
    tombstones: f"with {EVENTS}, {_latest('newest')} select key, seq, op, value from newest where op = 2",
    store_scan: _SCAN,
    store_log: f"with {EVENTS} select key, seq, op, value from log",
    store_snapshot: f"with {EVENTS}, {_latest('newest', 'seq <= 5000')} select key, value from newest where op = 1",
    store_pinned: _retain(5000, True),
    store_levels: f"with {EVENTS}, {_latest('newest')} select key, value, true as deep from newest where op = 1",
    store_tombstones: f"with {EVENTS}, {_latest('newest')} select key, seq, op, value from newest where op <> 2",
    reopen_overwrite: f"""with {EVENTS}, {_latest('newest')}
      select coalesce(n.key, c.key) as key, coalesce(c.value, n.value) as value
      from (select * from newest where op = 1) n full join (select printf('u%08d', c_custkey) as key, c_mktsegment as value from customer) c on n.key = c.key
      where coalesce(n.key, c.key) not in (select printf('u%08d', s_suppkey) from supplier)""",
    store_multi_get: f"""with {EVENTS}, {_latest('newest')}, asked as (select printf('u%08d', c_custkey) as key from customer)
      select a.key, n.value, n.key is not null as found from asked a left join (select * from newest where op = 1) n on a.key = n.key""",
    store_recovery: _SUPPLIERS,
    torn_tail: _SUPPLIERS,
    wal_import: """with step as (
      select s_suppkey, 1 as op, s_name, s_nationkey::varchar as value from supplier
      union all select s_suppkey, 2, s_name, null from supplier where s_acctbal < 0)
      select s_name as key, row_number() over (order by s_suppkey, op) as seq, op, value from step""",
    binary_keys: """with byte as (select event_id, printf('%02X', (event_id * 37) % 256) as b from events),
      rows as (select event_id, b || case when event_id % 5 = 0 then '' when event_id % 2 = 0 then '00' else 'FF' end as key, b as value from byte)
      select key, last(value order by event_id) as value from rows where key >= '0000' and key < 'FF00' group by key""",
    base64_values: f"with {EVENTS}, {_latest('newest')} select key, to_base64(encode(value)) as value from newest where op = 1",
    metrics_text: f"""with {EVENTS}, n as (select count(*) filter (op = 1) as puts, count(*) filter (op = 2) as deletes from log),
      r as (select count(*) as gets, count(*) filter (r_name = 'EUROPE') as hits from region)
      select 'tidemark_' || unnest(['puts_total', 'deletes_total', 'gets_total', 'get_hits_total', 'get_misses_total', 'scans_total', 'active_snapshots', 'memtable_entries', 'get_duration_seconds_count']) as name,
        unnest([puts + 1, deletes, gets, hits, gets - hits, 1, 0, 1, gets]) as value from n, r""",
    window_counts: """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, count(*) filter (event_type <> 'error') as puts,
      count(*) filter (event_type = 'error') as deletes from events group by 1""",
    stream_ingest: _SCAN,
}

QUERIES = {query.__name__: query for query in _QUERIES}
ORACLES = {query.__name__: sql for query, sql in _QUERIES.items()}
