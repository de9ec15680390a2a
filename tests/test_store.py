import pytest
from pyspark.sql import functions as F

from tests.logs import log, rows
from tidemark.functions.codec import typed
from tidemark.model import ClosedError, ConflictError, CorruptLogError, EmptyKeyError, NotFoundError, OrderError, StoreError, StoreOptions
from tidemark.operators.compact import Run, is_bottommost, level_target, pick
from tidemark.plans.manifest import load
from tidemark.plans.store import Store
from tidemark.sources.files import Files
from tidemark.sources.runs import read_runs, verify_run, write_run
from tidemark.sources.wal import Record, frame, parse, read_wal


@pytest.fixture
def store(spark, tmp_path):
    with Store(spark, f"{tmp_path}/store") as s:
        yield s


def scanned(view, *args):
    return [(k.decode(), v.decode()) for k, v in rows(view.scan(*args))]


def batch(spark, items):
    return spark.createDataFrame([(i, k.encode(), v.encode()) for i, (k, v) in enumerate(items)], "i long, key binary, value binary")


def missing(view, key):
    with pytest.raises(NotFoundError):
        view.get(key)
    return True


def test_put_get_delete(store):
    store.put(b"foo", b"bar")
    assert store.get(b"foo") == b"bar"
    store.delete(b"foo")
    store.delete(b"blind")
    assert missing(store, b"foo") and missing(store, b"never")
    store.put(b"empty", b"")
    assert store.get(b"empty") == b""


def test_overwrite_in_memory_and_over_runs(store):
    for i in range(5):
        store.put(b"k", f"v{i}".encode())
        if i == 2:
            store.flush()
    assert store.get(b"k") == b"v4"
    store.flush()
    assert store.get(b"k") == b"v4"


def test_range_scan(store):
    for i in range(20):
        store.put(f"k{i:02d}".encode(), f"v{i:02d}".encode())
        if i in (7, 14):
            store.flush()
    store.delete(b"k05")
    store.delete(b"k10")
    assert [k for k, _ in scanned(store, b"k03", b"k12")] == ["k03", "k04", "k06", "k07", "k08", "k09", "k11"]
    assert [k for k, _ in scanned(store, b"k03", None, 2)] == ["k03", "k04"]
    assert scanned(store, b"k12", b"k03") == [] and scanned(store, None, b"") == []
    assert len(list(store.rows())) == 18


def test_snapshot_isolation(store):
    store.put(b"k", b"before")
    with store.snapshot() as snap:
        store.put(b"k", b"after")
        store.delete(b"k")
        store.put(b"new", b"x")
        store.flush()
        store.compact()
        store.vacuum()
        assert snap.get(b"k") == b"before" and missing(store, b"k") and missing(snap, b"new")
        assert scanned(snap) == [("k", "before")] and scanned(store) == [("new", "x")]
    snap.close()
    with pytest.raises(ClosedError):
        snap.get(b"k")


def test_snapshots_pin_what_compaction_keeps(store):
    store.put(b"k", b"1")
    first = store.snapshot()
    store.put(b"k", b"2")
    second = store.snapshot()
    store.put(b"k", b"3")
    store.compact()
    assert store.keep_seq() == 1 and store.log().count() == 3
    assert [v.get(b"k") for v in (first, second, store)] == [b"1", b"2", b"3"]
    first.close()
    store.compact()
    assert store.log().count() == 2 and second.get(b"k") == b"2"
    second.close()
    store.compact()
    assert store.keep_seq() is None and store.log().count() == 1


def test_levels_and_bottommost_tombstones(spark, tmp_path):
    options = StoreOptions(flush_threshold=400, l0_trigger=2, base_level_bytes=200, level_multiplier=2)
    with Store(spark, f"{tmp_path}/s", options) as s:
        for i in range(40):
            s.put(f"key-{i:04d}".encode(), b"x" * 10)
        for i in range(20):
            s.delete(f"key-{i:04d}".encode())
        s.flush()
        s.maintain()
        per_level = s.stats()["runs_per_level"]
        assert sum(per_level[1:]) >= 1 and per_level[0] < 2
        assert [k for k, _ in scanned(s)] == [f"key-{i:04d}" for i in range(20, 40)]
        s.compact()
        assert s.log().count() == 20
        assert s.runs().count() == 1 and s.stats()["runs"] == 1
        gone = s.vacuum()
        assert gone and len(scanned(s)) == 20


def test_reopen_keeps_order_of_versions(spark, tmp_path):
    path = f"{tmp_path}/s"
    with Store(spark, path) as s:
        s.put(b"a", b"1")
        s.put(b"b", b"1")
    with Store(spark, path) as s:
        assert s.get(b"a") == b"1"
        with s.snapshot() as snap:
            assert scanned(snap) == [("a", "1"), ("b", "1")]
        s.put(b"a", b"2")
        s.delete(b"b")
    with Store(spark, path) as s:
        assert scanned(s) == [("a", "2")]


def test_crash_recovers_from_the_log(spark, tmp_path):
    path = f"{tmp_path}/s"
    lost = Store(spark, path)
    for i in range(20):
        lost.put(f"k{i}".encode(), f"v{i}".encode())
    lost.delete(b"k10")
    wal = next((tmp_path / "s" / "wal").glob("*.wal"))
    with open(wal, "ab") as f:
        f.write(bytes.fromhex("deadbeef0102"))
    with Store(spark, path) as s:
        assert len(scanned(s)) == 19 and missing(s, b"k10") and s.get(b"k19") == b"v19"
        assert [p for p in (tmp_path / "s" / "wal").glob("*.wal")] == []
        s.put(b"k10", b"again")
        assert s.get(b"k10") == b"again"


def test_a_crash_before_the_commit_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    s = Store(spark, path)
    s.put(b"a", b"1")
    s.flush()
    s.put(b"a", b"2")
    s.flush()
    monkeypatch.setattr(s, "_commit", lambda new: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        s.compact()
    assert s.metrics.compaction_failures.value == 1
    with Store(spark, path) as again:
        assert again.get(b"a") == b"2" and len(again.vacuum()) == 1 and again.get(b"a") == b"2"


def test_batches(spark, store):
    store.put_all(batch(spark, [(f"k{i:03d}", f"v{i}") for i in range(300)]), "i")
    store.put_all(batch(spark, [("k001", "first"), ("k001", "second")]), "i")
    store.delete_all(spark.createDataFrame([(0, b"k000"), (1, b"absent")], "i long, key binary"), "i")
    assert store.get(b"k001") == b"second" and missing(store, b"k000") and len(scanned(store)) == 299
    store.put(b"k000", b"back")
    assert store.get(b"k000") == b"back"
    found = store.multi_get(spark.createDataFrame([(b"k000",), (b"absent",)], "key binary"))
    assert sorted(rows(found), key=repr) == [(b"absent", None, False), (b"k000", b"back", True)]
    assert store.metrics.puts.value == 303 and store.metrics.deletes.value == 2
    for run in store._manifest.runs:
        verify_run(spark, store._files.full(run.path))
    assert sorted(r.seq for r in store.log().select("seq").collect()) == list(range(1, 306))


def test_batches_reject_empty_keys_and_unknown_ops(spark, store):
    with pytest.raises(EmptyKeyError):
        store.put_all(batch(spark, [("a", "1"), ("", "2")]), "i")
    with pytest.raises(StoreError):
        store.apply(batch(spark, [("a", "1")]).withColumn("op", F.lit(3)), "i")
    store.apply(batch(spark, []).withColumn("op", F.lit(1)), "i")
    assert scanned(store) == []


def test_views_and_typed_values(spark, store):
    store.put(b"a", b'{"n": 1}')
    with store.snapshot() as snap:
        store.put(b"a", b'{"n": 2}')
        store.put(b"b", b"not json")
        store.view("now_rows")
        store.view("then_rows", snap)
        got = spark.sql("select decode(n.key, 'UTF-8') as k, octet_length(t.value) as old from now_rows n left join then_rows t on n.key = t.key")
        assert sorted(map(tuple, got.collect())) == [("a", 8), ("b", None)]
        assert sorted(rows(typed(store.scan(), "n int"))) == [(b"a", 2), (b"b", None)]


def test_load_log(spark, store):
    store.load_log(log(spark, [("a", 5, "x"), ("a", 9, None), ("b", 7, "y")]))
    assert scanned(store) == [("b", "y")]
    with pytest.raises(StoreError):
        store.load_log(log(spark, [("a", 9, "x")]))
    store.load_log(log(spark, []))
    with pytest.raises(OrderError):
        store.load_log(log(spark, [("c", 20, "x"), ("c", 20, "y")]))
    store.load_log(log(spark, [("c", 20, "x"), ("d", 20, "y")]))
    assert scanned(store) == [("b", "y"), ("c", "x"), ("d", "y")]


def test_errors_and_closing(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s")
    for key in (b"", None):
        for call in (s.get, s.delete, lambda k: s.put(k, b"x")):
            with pytest.raises(EmptyKeyError):
                call(key)
    assert s.metrics.puts.value == 0
    assert s.metrics.gets.value == 2 and s.metrics.get_misses.value == 0
    s.put(b"k", b"v")
    s.close()
    s.close()
    for call in (lambda: s.get(b"a"), lambda: s.put(b"a", b"b"), s.scan, s.snapshot, s.compact, s.stats):
        with pytest.raises(ClosedError):
            call()
    with pytest.raises(StoreError):
        Store(spark, f"{tmp_path}/s", StoreOptions(max_levels=3))


def test_compression_option(spark, tmp_path):
    sizes = {}
    for compress in (False, True):
        with Store(spark, f"{tmp_path}/{compress}", StoreOptions(compress=compress)) as s:
            for i in range(10):
                s.put(f"k{i}".encode(), b"abcde" * 1600 + bytes([i]))
        with Store(spark, f"{tmp_path}/{compress}", StoreOptions(compress=not compress)) as s:
            assert s.get(b"k3") == b"abcde" * 1600 + b"\x03"
            sizes[compress] = s.runs().agg(F.sum("size_bytes")).first()[0]
    assert sizes[True] < sizes[False]


def test_a_later_owner_keeps_all_acknowledged_writes(spark, tmp_path):
    path = f"{tmp_path}/s"
    first = Store(spark, path)
    first.put(b"a", b"1")
    first.flush()
    first.put(b"b", b"1")
    second = Store(spark, path)
    assert scanned(second) == [("a", "1"), ("b", "1")]
    for call in (lambda: first.put(b"c", b"1"), first.flush, first.compact, first.vacuum, lambda: first.load_log(log(spark, [("x", 99, "y")]))):
        with pytest.raises(ConflictError):
            call()
    first.close()
    second.put(b"c", b"2")
    second.close()
    with Store(spark, path) as again:
        assert scanned(again) == [("a", "1"), ("b", "1"), ("c", "2")]


def test_an_owner_that_commits_while_another_opens(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/s"
    first = Store(spark, path)
    first.put(b"a", b"1")
    flush, raced = Store._flush, []

    def between(self):
        if self is not first and not raced:
            raced.append(True)
            flush(first)
        flush(self)

    monkeypatch.setattr(Store, "_flush", between)
    with Store(spark, path) as second:
        assert raced and scanned(second) == [("a", "1")] and second.log().count() == 1


def test_reading_only(spark, tmp_path):
    path = f"{tmp_path}/s"
    with Store(spark, path) as s:
        s.put(b"a", b"1")
        s.flush()
        s.put(b"b", b"1")
        with Store(spark, path, read_only=True) as reader:
            assert scanned(reader) == [("a", "1"), ("b", "1")] and reader.get(b"b") == b"1"
            for call in (lambda: reader.put(b"c", b"1"), reader.compact, reader.vacuum):
                with pytest.raises(StoreError):
                    call()
        s.put(b"c", b"1")
        assert len(scanned(s)) == 3


def test_only_one_of_several_creates_a_file(spark, tmp_path):
    files = Files(spark, f"{tmp_path}/f")
    files.make("x")
    assert [files.create("x/1", b"a"), files.create("x/1", b"b"), files.read("x/1"), files.names("x")] == [True, False, b"a", ["1"]]


def test_a_flush_during_a_get(spark, store, monkeypatch):
    store.put(b"k", b"1")
    store.flush()
    store.put(b"k", b"2")
    real = store._get

    def late(*args):
        store.flush()
        return real(*args)

    monkeypatch.setattr(store, "_get", late)
    assert store.get(b"k") == b"2"


def test_reads_and_writes_go_on_during_a_compaction(spark, tmp_path, monkeypatch):
    import threading

    from tidemark.plans import store as stores

    started, go_on, write = threading.Event(), threading.Event(), stores.write_run

    def slow(log, files, name, level, *rest):
        if level:
            started.set()
            assert go_on.wait(60)
        return write(log, files, name, level, *rest)

    monkeypatch.setattr(stores, "write_run", slow)
    with Store(spark, f"{tmp_path}/s") as s:
        for i in range(3):
            s.put(b"k%d" % i, b"old")
            s.flush()
        s.put(b"k0", b"dead")
        s.flush()
        s.delete(b"k0")
        work = threading.Thread(target=s.compact)
        work.start()
        assert started.wait(60) and s.maintain() == 0
        s.put(b"k1", b"new")
        s.flush()
        s.put(b"k2", b"newer")
        snap = s.snapshot()
        assert s.get(b"k1") == b"new" and s.get(b"k2") == b"newer" and missing(s, b"k0")
        go_on.set()
        work.join()
        s.put(b"k1", b"newest")
        s.vacuum()
        assert scanned(snap) == [("k1", "new"), ("k2", "newer")] and scanned(s) == [("k1", "newest"), ("k2", "newer")]
        assert s.stats()["runs_per_level"][:2] == [1, 1] and s.log().count() == 5
        snap.close()


def test_rows_keep_what_they_read(spark, store):
    for i in range(3):
        store.put(b"k%d" % i, b"v")
        store.flush()
    walk = store.rows()
    first = next(walk)
    store.compact()
    store.vacuum()
    assert [first, *walk] == [(b"k%d" % i, b"v") for i in range(3)] and not store._pins


def test_threads(spark, tmp_path):
    import threading

    with Store(spark, f"{tmp_path}/s") as s:

        def work(w):
            for i in range(30):
                key = f"w{w}-k{i}".encode()
                s.put(key, key)
                assert s.get(key) == key

        threads = [threading.Thread(target=work, args=(w,)) for w in range(6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(scanned(s)) == 180


def test_manifest_versions(spark, tmp_path, store):
    for i in range(3):
        store.put(b"k", bytes([i]))
        store.flush()
    files = Files(spark, f"{tmp_path}/store")
    found = load(files)
    assert found.version == 3 and found.max_seq == 3 and len(found.runs) == 3
    assert found.decode(found.encode()) == found


def test_pick():
    def run(level, gen, size=1):
        return Run(f"r{gen}", level, gen, 1, size, b"a", b"b", 1)

    options = StoreOptions(l0_trigger=2, base_level_bytes=10, level_multiplier=3, max_levels=4)
    assert pick([], options) is None and pick([run(0, 1)], options) is None
    assert {r.gen for r in pick([run(0, 1), run(0, 2), run(1, 3), run(2, 4)], options).inputs} == {1, 2, 3}
    assert pick([run(1, 1, 10)], options) is None
    assert (pick([run(1, 1, 11), run(2, 2)], options).target, pick([run(2, 1, 31)], options).target) == (2, 3)
    assert pick([run(3, 1, 10**9)], options) is None
    assert [level_target(i, options) for i in (1, 2, 3)] == [10, 30, 90]
    assert is_bottommost([run(1, 1)], 1) and not is_bottommost([run(2, 1)], 1)


def test_runs(spark, tmp_path):
    files = Files(spark, f"{tmp_path}/r")
    made = write_run(log(spark, [("b", 2, "y"), ("a", 1, "x"), ("c", 3, None)]), files, "one", 0, 1, StoreOptions())
    assert (made.num_entries, made.min_key, made.max_key, made.max_seq) == (3, b"a", b"c", 3) and made.size_bytes > 0
    assert [r[0] for r in rows(read_runs(spark, [files.full("one")]))] == [b"a", b"b", b"c"]
    assert write_run(log(spark, []), files, "none", 0, 2, StoreOptions()) is None and not files.exists("none")
    many = spark.range(2000).select(F.encode(F.format_string("k%05d", "id"), "UTF-8").alias("key"), "id", F.lit(1).alias("op"), F.lit(b"v" * 50).alias("value")).withColumnRenamed("id", "seq")
    write_run(many, files, "many", 0, 3, StoreOptions(file_bytes=1000), 5000)
    spans = read_runs(spark, [files.full("many")]).groupBy(F.input_file_name()).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("lo").collect()
    assert len(spans) == 5 and all(a.hi < b.lo for a, b in zip(spans, spans[1:], strict=False))
    verify_run(spark, files.full("many"))
    made = write_run(many, files, "more", 0, 3, StoreOptions(file_bytes=1000), 5000)
    assert len(made.files) == 5 and len(made.paths(b"k00700", b"k00700\0")) == 1 and made.paths(b"x", None) == []
    hot = spark.range(2000).select(F.lit(b"k").alias("key"), F.col("id").alias("seq"), F.lit(1).alias("op"), F.lit(b"v").alias("value"))
    assert len(write_run(hot, files, "hot", 0, 4, StoreOptions(file_bytes=1000), 5000).files) == 5
    verify_run(spark, files.full("hot"))
    for bad in ([("k", 1, "x"), ("k", 1, "y")], [("k", 1, "x"), ("k", 2, "y")], [("k", 1, "x"), ("a", 2, "y")]):
        log(spark, bad).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/bad")
        with pytest.raises(OrderError):
            verify_run(spark, f"{tmp_path}/bad")


def test_log_frames(spark, tmp_path):
    records = [Record(b"a", 1, 1, b"x"), Record(b"\x00\xff", 2, 2, None), Record(b"e", 3, 1, b"")]
    data = b"".join(map(frame, records))
    assert list(parse(data)) == records
    for cut in range(len(data)):
        assert list(parse(data[:cut])) == records[: len(list(parse(data[:cut])))]
    damaged = bytearray(data)
    damaged[len(frame(records[0])) + 21] ^= 1
    assert list(parse(bytes(damaged))) == records[:1]
    with pytest.raises(CorruptLogError):
        list(parse(frame(Record(b"a", 1, 7, b"x"))))
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "1.wal").write_bytes(data)
    (tmp_path / "w" / "2.wal").write_bytes(frame(Record(b"a", 4, 1, b"y")) + b"torn")
    got = sorted(rows(read_wal(spark, f"{tmp_path}/w")), key=lambda r: r[1])
    assert got == [tuple(r) for r in records] + [(b"a", 4, 1, b"y")]
    assert read_wal(spark, f"{tmp_path}/nothing").count() == 0
    assert spark.createDataFrame([(b"123456789",)], "v binary").select(F.crc32("v")).first()[0] == 0xCBF43926


def test_kept_logs(spark, tmp_path):
    """All single writes are in the logs, however often the store has flushed and was opened."""
    options = StoreOptions(flush_threshold=200, keep_logs=True)
    crashed = Store(spark, f"{tmp_path}/store", options)
    for i in range(10):
        crashed.put(f"k{i}".encode(), b"v")
    with Store(spark, f"{tmp_path}/store", options) as store:
        store.delete(b"k3")
        store.put(b"k4", b"w")
        assert len(scanned(store)) == 9
    got = sorted(rows(read_wal(spark, f"{tmp_path}/store/wal")), key=lambda r: r[1])
    assert got == [(f"k{i}".encode(), i + 1, 1, b"v") for i in range(10)] + [(b"k3", 11, 2, None), (b"k4", 12, 1, b"w")]
    assert len(scanned(Store(spark, f"{tmp_path}/store", options))) == 9


def test_import_of_logs_that_were_flushed(spark, tmp_path):
    from tidemark.plans.registry import wal_import

    names = [f"{i}" * (1 << 20) for i in range(6)]
    spark.createDataFrame([(i, n, i, float(i % 2 - 1)) for i, n in enumerate(names)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = [(r.key[0], len(r.key), r.seq, r.op) for r in wal_import(spark, str(tmp_path)).orderBy("seq").collect()]
    steps = [(n[0], op) for i, n in enumerate(names) for op in ((1, 2) if i % 2 == 0 else (1,))]
    assert got == [(first, 1 << 20, i + 1, op) for i, (first, op) in enumerate(steps)]


def test_writes_list_owners_without_hadoop(spark, store, monkeypatch):
    store.put(b"k0", b"v")
    asked = []
    path = store._files._path
    monkeypatch.setattr(store._files, "_path", lambda name: asked.append(name) or path(name))
    for i in range(1, 10):
        store.put(f"k{i}".encode(), b"v")
        store.delete(b"k0")
    assert asked == [] and len(scanned(store)) == 9


def test_names(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}/n")
    files.write("f/b", b"x")
    files.make("f/a")
    assert files.names("f") == ["a", "b"] and files.names("none") == []


def test_files_of_a_run_hold_few_entries(spark, tmp_path, monkeypatch):
    """However small the rows are: what a task sorts is bounded, by counts of the store or of the log itself."""
    from tidemark.operators.stats import check_order
    from tidemark.sources import runs

    monkeypatch.setattr(runs, "FILE_ENTRIES", 100)
    rows_ = spark.range(1000).select((F.col("id") * 7 % 1000).alias("i"), F.encode(F.format_string("k%02d", F.col("id") % 20), "UTF-8").alias("key"), F.lit(b"v").alias("value"))
    log_ = rows_.select("key", F.col("i").alias("seq"), F.lit(1).alias("op"), "value")
    files = Files(spark, f"{tmp_path}/r")
    made = write_run(log_, files, "one", 0, 1, StoreOptions())
    assert len(made.files) == 10 and (made.num_entries, made.min_key, made.max_key, made.max_seq) == (1000, b"k00", b"k19", 999)
    for name, low, high in made.files:
        keys = sorted(bytes(r.key).hex() for r in read_runs(spark, [files.full(f"one/{name}")]).collect())
        assert (keys[0], keys[-1]) == (low, high) and len(keys) < 300
    found = check_order(read_runs(spark, [files.full("one")]), runs.run_folder(), F.col("_metadata.row_index"), runs.file_number(), 30).first()
    assert tuple(found) == (1000, 1, 0)
    with Store(spark, f"{tmp_path}/store") as store:
        store.put_all(rows_, "i")
        assert len(store._manifest.runs[0].files) == 10 and len(scanned(store)) == 20
        with store.snapshot():
            store.put(b"k00", b"w")
            store.compact()
            assert len(store._manifest.runs[0].files) > 1
            assert store.get(b"k00") == b"w" and store.log().count() == 21


def test_parts_of_a_batch_hold_few_rows(spark, tmp_path, monkeypatch):
    """What a task sorts to number a batch doesn't depend on the number of shuffle partitions."""
    from tidemark.plans import store as stores

    monkeypatch.setattr(stores, "BATCH_ENTRIES", 100)
    rows_ = spark.range(1000).select((F.col("id") * 7 % 1000).alias("i")).withColumn("key", F.encode(F.format_string("k%03d", "i"), "UTF-8")).withColumn("value", F.lit(b"v"))
    with Store(spark, f"{tmp_path}/store") as store:
        parts, delete = [], store._files.delete

        def watched(name):
            if ".draft" in name:
                parts.append([r["count"] for r in spark.read.parquet(store._files.full(name)).groupBy("part").count().collect()])
            delete(name)

        monkeypatch.setattr(store._files, "delete", watched)
        store.put_all(rows_, "i")
        store.put_all(rows_.where("i < 50"), "i")
        assert sum(parts[0]) == 1000 and max(parts[0]) < 300 and parts[1] == [50]
        got = sorted((r[1], r[0]) for r in rows(store.log()))
        assert got == [(i + 1, f"k{i % 1000:03d}".encode()) for i in range(1050)]


def test_files_of_runs_are_read_by_tasks_of_their_own(spark, tmp_path, monkeypatch):
    """However small the files are, a task that ranks versions has about one of them."""
    from tidemark.plans import store as stores
    from tidemark.sources import runs

    monkeypatch.setattr(runs, "FILE_ENTRIES", 100)
    rows_ = spark.range(2000).select((F.col("id") * 7 % 2000).alias("i"), F.encode(F.format_string("k%04d", F.col("id") % 500), "UTF-8").alias("key"), F.lit(b"v").alias("value"))

    def largest(log_):
        return max(r["count"] for r in log_.groupBy(F.spark_partition_id()).count().collect())

    with Store(spark, f"{tmp_path}/store") as store:
        store.put_all(rows_, "i")
        paths = [store._files.full(p) for p in store._manifest.runs[0].paths(None, None)]
        assert len(paths) == 20 and largest(runs.read_files(spark, paths)) < 200 and largest(store.log()) < 200
        assert len(scanned(store)) == 500 and store.log().count() == 2000
        monkeypatch.setattr(runs, "READS", 2)
        assert runs.read_files(spark, paths).count() == 2000 and runs.read_files(spark, []).count() == 0
        asked, read = [], stores.read_files
        monkeypatch.setattr(stores, "read_files", lambda spark, paths: asked.append(len(paths)) or read(spark, paths))
        store.compact()
        assert asked == [20] and store.log().count() == 500


def test_many_keys_are_got_without_shuffling_all_versions(spark, tmp_path, monkeypatch):
    """Few keys cut the log, many don't; rows are the same."""
    from tidemark.plans import store as stores

    keys = spark.createDataFrame([(b"k1",), (b"k2",), (b"k2",), (b"k3",), (b"none",), (None,)], "key binary")
    with Store(spark, f"{tmp_path}/store") as store:
        store.put_all(spark.range(200).select("id", F.encode(F.format_string("k%d", F.col("id") % 20), "UTF-8").alias("key"), F.encode(F.col("id").cast("string"), "UTF-8").alias("value")), "id")
        store.delete(b"k3")
        want = sorted([(b"k1", b"181", True), (b"k2", b"182", True), (b"k2", b"182", True), (b"k3", None, False), (b"none", None, False), (None, None, False)], key=repr)
        for few in (6, 5):
            monkeypatch.setattr(stores, "FEW_KEYS", few)
            got = store.multi_get(keys)
            assert sorted(rows(got), key=repr) == want
            assert ("LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()) == (few == 6)
