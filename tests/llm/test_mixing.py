from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, empty, odd_docs, rows_of, words
from tidemark.llm import mixing
from tidemark.llm.mixing import apply_mix, mix_sources, targets


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """Reshare by weight what is above a source's cap until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 20, None: 5}, {"a": 100}, {"a": 0, "b": 7}, {"a": 1, "b": 1, "c": 1, "d": 1000, "é": 3, "z": 9}])
def test_targets_match_resharing(spark, sizes):
    rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute_targets(sizes)
    assert {r.source: r.target for r in rows} == pytest.approx(want)


def test_odd_documents(spark):
    docs = odd_docs(spark)
    out = mix_sources(docs).collect()
    assert sorted(r.id if r.id is not None else -1 for r in out) == sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect())
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(words(r.text))
    want, taken, largest = brute_targets(sizes), defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source, target in want.items():
        assert abs(taken[source] - target) <= largest[source]


def even(spark, n, groups=3):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % groups).alias("source"), F.expr("repeat('w ', cast(1 + id % 37 as int))").alias("text"))


def test_several_levels_come_near_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 8)
    docs = even(spark, 3000)
    first = mix_sources(docs)
    assert rows_of(first, "id", "copies") == rows_of(mix_sources(docs.repartition(7)), "id", "copies")
    for r in first.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect():
        assert r.n == 1000 and abs(r.taken - r.target) <= 37


def test_expected_copies(spark):
    docs = even(spark, 60, 2)
    total = defaultdict(float)
    for seed in range(12):
        for r in mix_sources(docs, seed=seed).collect():
            total[r.source] += r.copies / r.target * r.source_size / 30 / 12
    assert all(0.93 < share < 1.07 for share in total.values())


def test_sources_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    docs = odd_docs(spark)
    want = rows_of(mix_sources(docs), "id", "copies", "size")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows_of(mix_sources(docs), "id", "copies", "size") == want


def test_apply_repeats_rows(spark):
    docs = clashing(odd_docs(spark))
    out = apply_mix(docs)
    assert out.columns == docs.columns
    assert out.count() == mix_sources(docs).agg(F.sum("copies")).first()[0]
    assert out.join(docs, "doc_id", "left_anti").where("doc_id is not null").count() == 0


def test_equal_rows_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_BITS", 3)
    rows = spark.range(300, numPartitions=3).select(F.when(F.col("id") % 10 < 7, None).otherwise(F.col("id") % 10).alias("id"), F.lit(5).alias("key"), F.monotonically_increasing_id().alias("place"))
    got = mixing.numbered(rows, ["id", "key"], "place", "n")
    assert got.columns == ["id", "key", "place", "n"]
    for r in got.groupBy("id").agg(F.sort_array(F.collect_list("n")).alias("n")).collect():
        assert r.n == list(range(1, 211 if r.id is None else 31))


def test_many_equal_rows(spark, monkeypatch):
    """Each is drawn for itself, and the mix has as many of them as were drawn."""
    monkeypatch.setattr(mixing, "BLOCK_BITS", 4)
    docs = spark.range(400, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 300, "a").otherwise("b").alias("source"), F.lit("one two three").alias("text"), "id")
    drawn = {r.source: (r.n, r.least, r.most) for r in mix_sources(docs).groupBy("source").agg(F.sum("copies").alias("n"), F.min("copies").alias("least"), F.max("copies").alias("most")).collect()}
    assert drawn["a"][1] < drawn["a"][2] and drawn["a"][0] + drawn["b"][0] == pytest.approx(400, abs=2)
    out = apply_mix(docs)
    assert {r.source: r["count"] for r in out.groupBy("source").count().collect()} == {s: n for s, (n, _, _) in drawn.items()}
    assert out.groupBy("id").count().agg(F.max("count")).first()[0] <= 2


def test_empty_table(spark):
    assert mix_sources(empty(odd_docs(spark))).count() == 0
    assert apply_mix(empty(odd_docs(spark))).count() == 0


def test_native(spark):
    plan = mix_sources(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    plan += apply_mix(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
