import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.logs import b, live, log, retained, rows
from tidemark.functions.codec import base64_line, int_key, text_key
from tidemark.operators import compact, resolve, stats

KEYS = st.sampled_from([b"a", b"a\x00", b"\x00", b"\xff", b"\x7f", b"ab", b"zz"])
LOGS = st.lists(st.tuples(KEYS, st.one_of(st.none(), st.binary(max_size=3))), max_size=25)
SLOW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def numbered(mutations):
    return [(k, i + 1, v) for i, (k, v) in enumerate(mutations)]


@SLOW
@given(LOGS, st.one_of(st.none(), st.integers(0, 26)), st.one_of(st.none(), KEYS, st.just(b"")), st.one_of(st.none(), KEYS, st.just(b"")), st.integers(0, 4))
def test_scan_matches_model(spark, mutations, seq, start, end, limit):
    entries = numbered(mutations)
    want = [(k, v) for k, v in live(entries, seq).items() if (start is None or k >= start) and (end is None or k < end)]
    assert rows(resolve.scan(log(spark, entries), start, end, seq, limit)) == (want[:limit] if limit else want)


@SLOW
@given(LOGS, st.one_of(st.none(), st.integers(0, 26)), st.booleans())
def test_retention_matches_model_and_hides_nothing(spark, mutations, keep_seq, bottommost):
    entries = numbered(mutations)
    kept = compact.retain(log(spark, entries), keep_seq, bottommost)
    got = sorted((k, s, v) for k, s, _, v in rows(kept))
    assert got == retained(entries, keep_seq, bottommost)
    for seq in (None, *range(keep_seq if keep_seq is not None else 99, 27)):
        assert live(got, seq) == live(entries, seq)


@SLOW
@given(LOGS, st.integers(0, 26), st.integers(0, 26))
def test_diff_and_as_of_join_match_model(spark, mutations, a, c):
    entries = numbered(mutations)
    old, new = live(entries, a), live(entries, c)
    want = {k: (old.get(k), new.get(k)) for k in {*old, *new} if old.get(k) != new.get(k)}
    got = {bytes(r.key): (r.old_value, r.new_value) for r in resolve.diff(log(spark, entries), a, c).collect()}
    assert {k: tuple(v and bytes(v) if v is not None else None for v in x) for k, x in got.items()} == want
    probes = spark.createDataFrame([(b"a", a), (b"zz", c), (b"a", a)], "key binary, snap long")
    for block in (4, 1 << 20):
        found = {(bytes(r.key), r.snap): bytes(r.value) for r in resolve.as_of_join(log(spark, entries), probes, block=block).collect()}
        assert found == {(k, s): live(entries, s)[k] for k, s in [(b"a", a), (b"zz", c)] if k in live(entries, s)}


def test_as_of_versions(spark):
    df = log(spark, [("k", 30, "v30"), ("k", 20, "v20"), ("k", 10, "v10")])
    seen = {s: rows(resolve.get(df, b"k", s)) for s in (100, 30, 25, 20, 15, 10, 5)}
    want = {100: "v30", 30: "v30", 25: "v20", 20: "v20", 15: "v10", 10: "v10"}
    assert seen == {s: [(b"k", b(v))] for s, v in want.items()} | {5: []}


def test_get_of_deleted_missing_and_empty_values(spark):
    df = log(spark, [("foo", 1, "bar"), ("foo", 2, None), ("e", 3, "")])
    assert rows(resolve.get(df, b"foo")) == [] and rows(resolve.get(df, b"x")) == [] and rows(resolve.get(df, b"e")) == [(b"e", b"")]


def test_multi_get(spark):
    df = log(spark, [("a", 1, "1"), ("b", 2, "2"), ("b", 3, None), ("e", 4, "")])
    keys = spark.createDataFrame([(b"a",), (b"b",), (b"x",), (b"a",), (b"e",)], "key binary")
    assert sorted(rows(resolve.multi_get(df, keys)), key=repr) == sorted([(b"a", b"1", True)] * 2 + [(b"b", None, False), (b"x", None, False), (b"e", b"", True)], key=repr)


def test_negative_limit(spark):
    with pytest.raises(ValueError):
        resolve.scan(log(spark, []), limit=-1)


def test_merge_drops_and_retains(spark):
    tombstone = [("k", 10, "v10"), ("k", 20, "v20"), ("k", 30, None)]
    kept = [(k, s, v) for k, s, _, v in rows(compact.retain(log(spark, tombstone), 15, True))]
    assert live(kept, 15) == {b"k": b"v10"} and live(kept) == {}
    dropped = compact.retain(log(spark, [("k1", 1, "old"), ("k2", 2, "keep"), ("k1", 5, None)]), None, True)
    assert [r[0] for r in rows(dropped)] == [b"k2"]
    assert len(rows(compact.retain(log(spark, [("k", 5, None)]), None, False))) == 1


def test_filters_reach_the_scan(spark, tmp_path):
    log(spark, [("a", 1, "x"), ("b", 2, "y")]).write.parquet(f"{tmp_path}/log")
    plan = resolve.scan(spark.read.parquet(f"{tmp_path}/log"), b"a", b"b", 7)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(key" in pushed and "LessThan(key" in pushed and "LessThanOrEqual(seq,7)" in pushed
    assert "WindowGroupLimit" in plan and "op" not in pushed.split("ReadSchema")[0]


def test_collapse_keeps_the_newest_of_each_generation(spark):
    from pyspark.sql import functions as F

    df = log(spark, [("a", 1, "1"), ("a", 2, "2"), ("a", 11, None), ("b", 12, "3")]).withColumn("gen", F.floor(F.col("seq") / 10))
    assert sorted(r[1] for r in rows(compact.collapse(df, "gen"))) == [2, 11, 12]


def test_histogram(spark):
    seconds = [(0.00005,), (0.00005,), (0.002,), (10.0,), (None,), (-1.0,)]
    got = {r.le: r.n for r in stats.histogram(spark.createDataFrame(seconds, "s double"), "s").collect()}
    assert got["0.0001"] == 3 and got["0.005"] == 4 and got["5.0"] == 4 and got["+Inf"] == 5


def test_order_check(spark):
    def violations(*placed):
        rows = spark.createDataFrame([(run, i, *row) for run, i, *row in placed], "run string, place int, key binary, seq long")
        return tuple(stats.check_order(rows, "run", "place").first())

    assert violations(("r", 0, b"a", 2), ("r", 1, b"a", 1), ("r", 2, b"b", 9), ("s", 0, b"a", 7)) == (4, 2, 0)
    assert violations(("r", 0, b"a", 1), ("r", 1, b"a", 2)) == violations(("r", 0, b"b", 1), ("r", 1, b"a", 2)) == violations(("r", 0, b"a", 1), ("r", 1, b"a", 1)) == (2, 1, 1)
    assert violations() == (0, 0, 0)


def test_order_check_in_blocks_and_files(spark):
    """Rows are held against the one before them across blocks and files of a run, and not across runs."""

    def violations(placed, block):
        rows = spark.createDataFrame(placed, "run string, file int, place int, key binary, seq long")
        return tuple(stats.check_order(rows, "run", "place", "file", block).first())

    keys = [b"a", b"b", b"b", b"d", b"c", b"e", b"e", b"f", b"f", b"a"]
    seqs = [1, 5, 4, 1, 1, 2, 2, 3, 4, 1]
    placed = [(run, i // 4, i % 4, k, s) for run in "rs" for i, (k, s) in enumerate(zip(keys, seqs, strict=True))]
    for block in (1, 2, 3, 100):
        assert violations(placed, block) == (20, 2, 8)
    assert violations([p for p in placed if p[1] == 1], 2) == (8, 2, 2)


def test_size_estimate_and_distinct_keys(spark):
    df = log(spark, [("ab", 1, "xyz"), ("ab", 2, None), ("c", 3, "")])
    assert dict(rows(stats.size_estimate(df))) == {b"ab": 53 + 50, b"c": 49}
    assert stats.distinct_keys(df).first().num_keys == 2


def test_keys_sort_like_what_they_stand_for(spark):
    df = spark.createDataFrame([(10, "é"), (9, "z"), (123, "a")], "n long, t string")
    assert [r.n for r in df.orderBy(int_key("n", "u", 8)).collect()] == [9, 10, 123]
    assert [r.t for r in df.orderBy(text_key("t")).collect()] == ["a", "z", "é"]
    assert "\n" not in spark.createDataFrame([(b"x" * 500,)], "v binary").select(base64_line("v")).first()[0]
