"""A store: a versioned log in a folder, with single writes through a write-ahead log and batch writes as runs.

State is the manifest with the highest number: a crash leaves at most files that no manifest names, which vacuum()
removes. Single puts and deletes are synced to a log file, then kept in memory until they are as large as a flush;
batches of any size are written by the executors as a run of their own. Every version keeps the sequence number that it
was given, and the highest number is part of the manifest, so order holds over reopening and compaction.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import replace
from functools import wraps
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.metrics import Registry, StoreMetrics
from tidemark.model import LOG_COLUMNS, LOG_SCHEMA, TOMBSTONE, VALUE, ClosedError, ConflictError, EmptyKeyError, NotFoundError, OrderError, StoreError, StoreOptions, check_key
from tidemark.operators import compact, resolve
from tidemark.operators.stats import ENTRY_OVERHEAD, entry_size
from tidemark.plans import manifest as manifests
from tidemark.plans.manifest import Manifest
from tidemark.sources.files import Files
from tidemark.sources.runs import read_files, read_runs, repeats, write_run
from tidemark.sources.wal import Record, Wal, parse

#: Manifest versions kept for readers that are behind.
KEPT_VERSIONS = 20
OWNERS, OPEN_ATTEMPTS, KEPT_LOGS = "owners", 5, "wal/kept"
#: Rows of a batch that a task sorts by their order at most, about.
BATCH_ENTRIES = 1 << 18
#: Keys of a multi_get up to which the log is cut to them before versions are ranked.
FEW_KEYS = 10_000


def run_name(level: int, gen: int) -> str:
    """A new name each time, so that what a crash or another writer left isn't in the way."""
    return f"runs/L{level:02d}-{gen:020d}-{uuid.uuid4().hex[:12]}"


def _open_only(method):
    @wraps(method)
    def checked(self, *args, **options):
        with self._lock:
            if self._closed:
                raise ClosedError
            return method(self, *args, **options)

    return checked


class Snapshot:
    """A fixed point of the store: its reads see no later write, and no file that they need is removed."""

    def __init__(self, store: Store, seq: int, runs: tuple[compact.Run, ...], memory: tuple[Record, ...]):
        self._store, self.seq, self.runs, self._memory, self._closed = store, seq, runs, memory, False

    def _check(self) -> None:
        if self._closed:
            raise ClosedError

    def log(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        self._check()
        return self._store._log(self.runs, self._memory, start, end, self.seq)

    def get(self, key: bytes) -> bytes:
        self._check()
        return self._store._recorded_get(key, self.runs, self._memory, self.seq)

    def scan(self, start: bytes | None = None, end: bytes | None = None, limit: int = 0) -> DataFrame:
        self._store.metrics.scans.inc()
        return resolve.scan(self.log(start, end), start, end, self.seq, limit)

    def close(self) -> None:
        if not self._closed:
            self._closed = True
            self._store._unpin(self)
            self._store.metrics.active_snapshots.inc(-1)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Store:
    """An open store. The last one that opens a folder for writing owns it: writes of an earlier one raise ConflictError.

    Owners are numbered by files that only one opener can make. A write is acknowledged if no later owner is there after
    the write is synced, and an owner reads the logs after it has its number, so it finds all that was acknowledged.
    With ``read_only`` nothing is taken over, recovered or deleted; reads see the state at the opening, logs included.
    """

    def __init__(self, spark: SparkSession, path: str, options: StoreOptions | None = None, registry: Registry | None = None, read_only: bool = False):
        self.spark, self.options, self.registry = spark, options or StoreOptions(), registry or Registry()
        self.metrics = StoreMetrics(self.registry)
        self._lock, self._compacting = threading.RLock(), threading.RLock()
        self._pins: list[Snapshot] = []
        self._closed = False
        self._files = Files(spark, path)
        self._wal: Wal | None = None
        self.read_only, self._owner = read_only, 0
        if not read_only:
            for folder in (manifests.FOLDER, "wal", "runs", OWNERS):
                self._files.make(folder)
            while not self._files.create(f"{OWNERS}/{self._last_owner() + 1:020d}", b""):
                pass
            self._owner = self._last_owner()
        for attempt in range(OPEN_ATTEMPTS):
            self._load()
            try:
                self._recover()
                break
            except ConflictError:
                # an earlier owner committed what it had in memory meanwhile
                if attempt == OPEN_ATTEMPTS - 1 or self._last_owner() != self._owner:
                    raise

    def _load(self) -> None:
        found = manifests.load(self._files)
        if found and found.max_levels > self.options.max_levels:
            raise StoreError(f"the store has {found.max_levels} levels, the options only {self.options.max_levels}")
        self._manifest = replace(found or Manifest(), max_levels=self.options.max_levels)
        self._seq = self._manifest.max_seq
        self._reset_memory()

    def _last_owner(self) -> int:
        return max((int(n) for n in self._files.names(OWNERS) if n.isdigit()), default=0)

    def _check_owner(self) -> None:
        if self.read_only:
            raise StoreError("the store is open for reading only")
        if self._last_owner() != self._owner:
            raise ConflictError("the store was opened for writing again")

    # memory and its log

    def _reset_memory(self) -> None:
        self._memory: list[Record] = []
        self._newest: dict[bytes, Record] = {}
        self._memory_bytes = 0

    def _recover(self) -> None:
        names = [n for n in self._files.names("wal") if n.endswith(".wal")]
        for name in names:
            for record in parse(self._files.read(f"wal/{name}")):
                if record.seq > self._manifest.max_seq:
                    self._remember(record)
        if self.read_only:
            return
        if self._memory:
            self._flush()
        for name in names:
            self._drop_log(f"wal/{name}")
        for name in self._files.names(OWNERS):
            if name.isdigit() and int(name) < self._owner:
                self._files.delete(f"{OWNERS}/{name}")

    def _drop_log(self, name: str) -> None:
        """A log whose records are in runs goes, or is kept for readers."""
        if self.options.keep_logs:
            self._files.make(KEPT_LOGS)
            self._files.move(name, f"{KEPT_LOGS}/{name.rpartition('/')[2]}")
        else:
            self._files.delete(name)

    def _remember(self, record: Record) -> None:
        self._memory.append(record)
        if record.key not in self._newest or self._newest[record.key].seq < record.seq:
            self._newest[record.key] = record
        self._memory_bytes += len(record.key) + len(record.value or b"") + ENTRY_OVERHEAD
        self._seq = max(self._seq, record.seq)

    @_open_only
    def _write(self, key: bytes, op: int, value: bytes | None) -> bool:
        """Whether the write made a run."""
        if self._wal is None:
            self._check_owner()
            # the number is taken by the manifest's next commit
            self._wal = Wal(self._files, f"wal/{self._owner:020d}-{self._manifest.next_gen:020d}.wal")
        record = Record(key, self._seq + 1, op, value)
        self._wal.append(record)
        self._check_owner()
        self._remember(record)
        if self._memory_bytes < self.options.flush_threshold:
            return False
        self.flush()
        return True

    def put(self, key: bytes, value: bytes) -> None:
        key, began = check_key(key), time.perf_counter()
        try:
            if self._write(key, VALUE, bytes(value or b"")):
                self._maintain_open()
        finally:
            self.metrics.write_seconds.observe(time.perf_counter() - began)
            self.metrics.puts.inc()

    def delete(self, key: bytes) -> None:
        key, began = check_key(key), time.perf_counter()
        try:
            if self._write(key, TOMBSTONE, None):
                self._maintain_open()
        finally:
            self.metrics.write_seconds.observe(time.perf_counter() - began)
            self.metrics.deletes.inc()

    @_open_only
    def flush(self) -> None:
        """Write what is in memory as a run of level 0."""
        if not self._memory or self.read_only:
            return
        self._check_owner()
        self._flush()
        if self._wal is not None:
            self._wal.close()
            self._drop_log(self._wal.name)
            self._wal = None

    def _flush(self) -> None:
        began = time.perf_counter()
        self.metrics.flushes.inc()
        try:
            self._add_run(self._frame(self._memory), self._memory_bytes, len(self._memory), max(r.seq for r in self._memory))
        except Exception:
            self.metrics.flush_failures.inc()
            raise
        finally:
            self.metrics.flush_seconds.observe(time.perf_counter() - began)
        self._reset_memory()

    def _frame(self, records) -> DataFrame:
        return self.spark.createDataFrame([(r.key, r.seq, r.op, r.value) for r in records], LOG_SCHEMA)

    # batches

    def _add_run(self, log: DataFrame, size: int, entries: int, max_seq: int | None, level: int = 0, batch: tuple[str, int] | None = None) -> None:
        gen = self._manifest.next_gen
        run = write_run(log, self._files, run_name(level, gen), level, gen, self.options, size, entries)
        batches = self._manifest.batches | ({batch[0]: batch[1]} if batch else {})
        top = max(self._manifest.max_seq, max_seq or 0, run.max_seq if run else 0)
        self._commit(replace(self._manifest, max_seq=top, next_gen=gen + 1, runs=(*self._manifest.runs, *([run] if run else [])), batches=batches))
        self._seq = max(self._seq, top)

    def _commit(self, new: Manifest) -> None:
        self._manifest = manifests.commit(self._files, new)
        manifests.expire(self._files, KEPT_VERSIONS)

    def apply(self, mutations: DataFrame, order_by: str | Column, batch: tuple[str, int] | None = None) -> bool:
        """Write a batch of (key, op, value) in the order of ``order_by``; False if this stream's batch is in the store.

        Rows are range-partitioned by the order and numbered within each partition; with the partitions' counts that gives
        seqs without gaps. Rows that tie in the order get either order. How many partitions, a count of the rows says:
        those that shuffles have otherwise would grow with the batch.
        """
        done = self._apply(mutations, order_by, batch)
        if done:
            self._maintain_open()
        return done

    @_open_only
    def _apply(self, mutations: DataFrame, order_by: str | Column, batch: tuple[str, int] | None) -> bool:
        if batch and self._manifest.batches.get(batch[0], -1) >= batch[1]:
            return False
        self._check_owner()
        self.flush()
        order = F.col(order_by) if isinstance(order_by, str) else order_by
        first = self._seq
        rows = mutations.select(order.alias("_order"), F.col("key").cast("binary").alias("key"), F.col("op").cast("int").alias("op"), F.col("value").cast("binary").alias("value"))
        checked = rows.select("_order", F.when(F.octet_length("key") > 0, F.col("key")).otherwise(F.raise_error("key must not be empty").cast("binary")).alias("key"), "op", "value")
        entries, size = rows.agg(F.count(F.lit(1)), F.sum(entry_size())).first()
        ranges = max(1, -(-entries // BATCH_ENTRIES), -(-(size or 0) // self.options.file_bytes))
        sorted_ = checked.repartitionByRange(ranges, "_order").sortWithinPartitions("_order")
        numbered = sorted_.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        value = F.when(F.col("op") == VALUE, F.coalesce("value", F.lit(b"")))
        gen = self._manifest.next_gen
        # the numbering is fixed by writing it once; sorting by key is a second step on what was written
        draft = f"runs/.draft-{gen:020d}-{uuid.uuid4().hex[:12]}"
        try:
            numbered.select("key", "op", value.alias("value"), "part", "nth").write.parquet(self._files.full(draft))
        except Exception as error:
            self._files.delete(draft)
            if "key must not be empty" in str(error):
                raise EmptyKeyError from None
            raise
        written = self.spark.read.schema("key binary, op int, value binary, part int, nth long").parquet(self._files.full(draft))
        # a row a partition and op
        counts, ops, parts = written.groupBy("part", "op").count().orderBy("part").collect(), {}, {}
        for row in counts:
            ops[row["op"]] = ops.get(row["op"], 0) + row["count"]
            parts[row["part"]] = parts.get(row["part"], 0) + row["count"]
        before = [first + 1, *accumulate(parts.values(), initial=first + 1)][1:-1] if parts else []
        offsets = self.spark.createDataFrame(list(zip(parts, before, strict=True)), "part int, offset long")
        log = written.join(F.broadcast(offsets), "part").select("key", (F.col("offset") + F.col("nth")).alias("seq"), "op", "value")
        if set(ops) - {VALUE, TOMBSTONE}:
            self._files.delete(draft)
            raise StoreError(f"op must be {VALUE} or {TOMBSTONE}")
        self.metrics.puts.inc(ops.get(VALUE, 0))
        self.metrics.deletes.inc(ops.get(TOMBSTONE, 0))
        self._add_run(log, self._files.size(draft), sum(ops.values()), None, batch=batch)
        self._files.delete(draft)
        return True

    def put_all(self, rows: DataFrame, order_by: str | Column) -> None:
        self.apply(rows.withColumn("op", F.lit(VALUE)), order_by)

    def delete_all(self, keys: DataFrame, order_by: str | Column) -> None:
        self.apply(keys.withColumn("op", F.lit(TOMBSTONE)).withColumn("value", F.lit(None).cast("binary")), order_by)

    def load_log(self, log: DataFrame) -> None:
        """Add a log that has its own seqs, all above those in the store."""
        self._load_log(log)
        self._maintain_open()

    @_open_only
    def _load_log(self, log: DataFrame) -> None:
        self._check_owner()
        self.flush()
        low, high, size, entries = log.agg(F.min("seq"), F.max("seq"), F.sum(entry_size()), F.count(F.lit(1))).first()
        if low is None:
            return
        if low <= self._seq:
            raise StoreError(f"seqs must be above {self._seq}")
        if not repeats(log).isEmpty():
            raise OrderError("a log must hold each version, (key, seq), once")
        self._add_run(log.select(*LOG_COLUMNS), size, entries, high)

    # reads

    def _log(self, runs, memory, start: bytes | None, end: bytes | None, seq: int | None) -> DataFrame:
        paths = [self._files.full(p) for r in runs for p in r.paths(start, end)]
        sources = [read_files(self.spark, paths)] if paths or not memory else []
        recent = [r for r in memory if (start is None or r.key >= start) and (end is None or r.key < end)]
        log = resolve.merge_sources(*sources, *([self._frame(recent)] if recent or not sources else []))
        return resolve.as_of(log, seq)

    @_open_only
    def log(self) -> DataFrame:
        """Every version in the store."""
        return self._log(self._manifest.runs, self._memory, None, None, None)

    def _recorded_get(self, key: bytes, runs, memory, seq: int | None, newest: dict[bytes, Record] | None = None) -> bytes:
        began = time.perf_counter()
        self.metrics.gets.inc()
        try:
            value = self._get(key, runs, memory, seq, newest)
            self.metrics.get_hits.inc()
            return value
        except NotFoundError:
            self.metrics.get_misses.inc()
            raise
        finally:
            self.metrics.get_seconds.observe(time.perf_counter() - began)

    def _get(self, key: bytes, runs, memory, seq: int | None, newest: dict[bytes, Record] | None) -> bytes:
        key = check_key(key)
        # versions in memory are newer than all runs; ``newest`` was taken together with them
        if newest is not None:
            mine = [newest[key]] if key in newest else []
        else:
            mine = [r for r in memory if r.key == key and (seq is None or r.seq <= seq)]
        if mine:
            last = max(mine, key=lambda r: r.seq)
            if last.op == TOMBSTONE:
                raise NotFoundError
            return last.value or b""
        near = [self._files.full(p) for r in runs for p in r.paths(key, key + b"\0")]
        row = resolve.get(read_runs(self.spark, near), key, seq).first() if near else None
        if row is None:
            raise NotFoundError
        return bytes(row["value"])

    def get(self, key: bytes) -> bytes:
        with self._lock:
            closed, runs, memory, newest = self._closed, self._manifest.runs, self._memory, self._newest
        if closed:
            raise ClosedError
        return self._recorded_get(key, runs, memory, None, newest)

    @_open_only
    def scan(self, start: bytes | None = None, end: bytes | None = None, limit: int = 0) -> DataFrame:
        """``key, value`` in key order. The DataFrame is lazy: it reads the runs of now, which stay until vacuum()."""
        self.metrics.scans.inc()
        return resolve.scan(self._log(self._manifest.runs, self._memory, start, end, None), start, end, None, limit)

    def view(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        """Register the live keys and values, of now or of a snapshot, as a temporary view for SQL."""
        log, seq = (snapshot.log(), snapshot.seq) if snapshot else (self.log(), None)
        live = resolve.visible(resolve.latest(log, seq)).select("key", "value")
        live.createOrReplaceTempView(name)
        return live

    def rows(self, start: bytes | None = None, end: bytes | None = None, limit: int = 0) -> Iterator[tuple[bytes, bytes]]:
        """The same, a partition at a time to the driver; what it reads stays until it ends."""
        if limit < 0:
            raise ValueError("limit must not be negative")
        self.metrics.scans.inc()
        pin = self._pin()

        def walk() -> Iterator[tuple[bytes, bytes]]:
            try:
                for r in resolve.scan(pin.log(start, end), start, end, pin.seq, limit).toLocalIterator():
                    yield bytes(r["key"]), bytes(r["value"])
            finally:
                self._unpin(pin)

        return walk()

    @_open_only
    def _pin(self) -> Snapshot:
        self._pins.append(Snapshot(self, self._seq, self._manifest.runs, tuple(self._memory)))
        return self._pins[-1]

    @_open_only
    def multi_get(self, keys: DataFrame) -> DataFrame:
        """Each row of ``keys`` with ``value`` and ``found``.

        To cut the log to many keys would shuffle all its versions; ranked first, a task sends one of each key.
        """
        few = keys.select("key").limit(FEW_KEYS + 1).count() <= FEW_KEYS
        return resolve.multi_get(self.log(), keys, cut=few)

    @_open_only
    def snapshot(self) -> Snapshot:
        pin = self._pin()
        self.metrics.snapshots_opened.inc()
        self.metrics.active_snapshots.inc()
        return pin

    def _unpin(self, pin: Snapshot) -> None:
        with self._lock:
            self._pins.remove(pin)

    def keep_seq(self) -> int | None:
        """The oldest seq that a snapshot reads at; None without snapshots."""
        return min((p.seq for p in self._pins), default=None)

    # maintenance

    def _maintain_open(self) -> None:
        """Maintenance after a write, which is done even if the store is closed meanwhile."""
        try:
            self.maintain()
        except ClosedError:
            pass

    def maintain(self) -> int:
        """Compact until no level is due; the number of compactions. If another thread is at it, that one goes on."""
        done = 0
        if not self._compacting.acquire(blocking=False):
            return done
        try:
            while plan := compact.pick(self._manifest.runs, self.options):
                self.compact(plan)
                done += 1
        finally:
            self._compacting.release()
        return done

    def compact(self, plan: compact.Plan | None = None) -> None:
        """One compaction; without a plan, of all runs to the deepest level in use.

        Reads and writes go on while the new run is written: snapshots that are opened meanwhile keep the runs that they
        found, and runs that are added stay beside the new one.
        """
        with self._compacting:
            self._compact(plan)

    @_open_only
    def _plan(self, plan: compact.Plan | None) -> tuple[compact.Plan, tuple[compact.Run, ...], int | None, int] | None:
        """(what to compact, the runs beside it, the oldest seq in use, the new run's generation)"""
        self._check_owner()
        if plan is None:
            self.flush()
            if not self._manifest.runs:
                return None
            plan = compact.Plan(self._manifest.runs, max(1, *(r.level for r in self._manifest.runs)))
        gen = self._manifest.next_gen
        self._manifest = replace(self._manifest, next_gen=gen + 1)
        return plan, tuple(r for r in self._manifest.runs if r not in plan.inputs), self.keep_seq(), gen

    def _compact(self, plan: compact.Plan | None) -> None:
        planned = self._plan(plan)
        if planned is None:
            return
        plan, rest, keep, gen = planned
        began = time.perf_counter()
        self.metrics.compactions.inc()
        try:
            log = read_files(self.spark, [self._files.full(p) for r in plan.inputs for p in r.paths(None, None)])
            kept = compact.retain(log, keep, compact.is_bottommost(rest, plan.target))
            run = write_run(kept, self._files, run_name(plan.target, gen), plan.target, gen, self.options, sum(r.size_bytes for r in plan.inputs), sum(r.num_entries for r in plan.inputs))
            with self._lock:
                self._check_owner()
                self._commit(replace(self._manifest, runs=(*(r for r in self._manifest.runs if r not in plan.inputs), *([run] if run else []))))
        except Exception:
            self.metrics.compaction_failures.inc()
            raise
        finally:
            self.metrics.compaction_seconds.observe(time.perf_counter() - began)

    def vacuum(self) -> list[str]:
        """Delete runs that neither the manifest nor an open snapshot names; scans made before may then fail."""
        with self._compacting:
            return self._vacuum()

    @_open_only
    def _vacuum(self) -> list[str]:
        self._check_owner()
        used = {r.path.removeprefix("runs/") for r in self._manifest.runs} | {r.path.removeprefix("runs/") for p in self._pins for r in p.runs}
        gone = [n for n in self._files.names("runs") if n not in used]
        for name in gone:
            self._files.delete(f"runs/{name}")
        return gone

    @_open_only
    def stats(self) -> dict:
        per_level = [0] * self.options.max_levels
        for run in self._manifest.runs:
            per_level[run.level] += 1
        self.metrics.memory_entries.set(len(self._newest))
        self.metrics.immutable_tables.set(0)
        self.metrics.runs.set(len(self._manifest.runs))
        for level, n in enumerate(per_level):
            self.metrics.runs_per_level.set(str(level), n)
        return {"memtable_entries": len(self._newest), "immutable_memtables": 0, "runs": len(self._manifest.runs), "runs_per_level": per_level}

    def runs(self) -> DataFrame:
        """The manifest's runs as a table."""
        rows = [(r.path, r.level, r.gen, r.num_entries, r.size_bytes, r.min_key, r.max_key, r.max_seq) for r in self._manifest.runs]
        return self.spark.createDataFrame(rows, "path string, level int, gen long, num_entries long, size_bytes long, min_key binary, max_key binary, max_seq long")

    def render_metrics(self) -> str:
        if not self._closed:
            self.stats()
        return self.registry.render()

    def close(self) -> None:
        """Flush and close; a second call does nothing."""
        with self._compacting, self._lock:
            if self._closed:
                return
            try:
                self.flush()
            except ConflictError:
                # the later owner has read from the log what is in memory here
                if self._last_owner() == self._owner:
                    raise
            self._closed = True

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()


__all__ = ["ConflictError", "Snapshot", "Store"]
