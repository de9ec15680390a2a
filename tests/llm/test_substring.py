from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, empty, odd_docs, odd_rows, rows_of, words
from tidemark.llm import substring
from tidemark.llm.substring import dedup_substrings, doubling, least, ranges
from tidemark.llm.words import Words, window_hashes


def brute(texts, n):
    """(words, removed, kept text) of each text."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        drop = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                drop[i : i + n] = [True] * n
        out.append((len(w), sum(drop), " ".join(x for x, d in zip(w, drop, strict=True) if not d)))
    return out


@pytest.mark.parametrize("n", [1, 3, 5, 8, 35])
@pytest.mark.parametrize("chunk_bytes", [2_000, 1 << 20])
def test_matches_brute_force(spark, n, chunk_bytes):
    rows = odd_rows()
    got = rows_of(dedup_substrings(odd_docs(spark), n, chunk_bytes=chunk_bytes), "doc_id", "n_words", "n_removed", "kept_text")
    assert got == sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], n), strict=True)), key=repr)


def test_repeats_within_one_text(spark):
    text = " ".join(map(str, range(50))) + " x " + " ".join(map(str, range(50))) + " y"
    row = dedup_substrings(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_removed, row.kept_text) == (102, 100, "x y")


def test_keeps_columns_and_replaces_clashing_ones(spark):
    docs = clashing(odd_docs(spark))
    out = dedup_substrings(docs)
    assert out.columns == [c for c in docs.columns if c not in ("n_words", "kept_text")] + ["n_words", "n_removed", "kept_text"]
    assert out.where("score = 'mine score' and size(extra) = 1").count() == docs.count()


def test_empty_table(spark):
    assert dedup_substrings(empty(odd_docs(spark))).count() == 0


def test_more_chunks_than_buckets_are_allowed(spark):
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "5")
    try:
        rows = odd_rows()
        got = rows_of(dedup_substrings(odd_docs(spark), 8, chunk_bytes=400), "doc_id", "n_words", "n_removed", "kept_text")
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    assert got == sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 8), strict=True)), key=repr)


def test_equal_rows_are_dealt_to_many_chunks(spark):
    docs = spark.range(3000).select(F.lit(" ".join(f"w{i}" for i in range(40))).alias("text"))
    out = dedup_substrings(docs, chunk_bytes=20_000)
    assert out.where("n_removed = 40 and kept_text = ''").count() == 3000
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_query(spark, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = substring.op1_substring_dedup(spark, str(tmp_path))
    want = dedup_substrings(odd_docs(spark)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert rows_of(out, *out.columns) == rows_of(want, *want.columns)


def test_levels():
    assert doubling(35) == [9, 18, 35]
    for n in range(4, 80):
        a, b, c = doubling(n)
        assert c == n and b <= 2 * a and c <= 2 * b


def test_packed_places():
    rng = np.random.default_rng(3)
    for step in (0, 1):
        for values in ([], [5], [0, 1, 2, 7, 8, 8, 8, 30], np.flatnonzero(rng.random(5000) < 0.9), np.sort(rng.integers(0, 50, 900))):
            packed = substring.pack(np.array(values, np.int64), step)
            assert substring.unpack(packed, step).tolist() == list(values)
    assert len(substring.pack(np.arange(10**6), 1)) == 8


def test_least_and_ranges():
    x = np.array([5, 3, 3, 9, 1, 7], np.uint64)
    assert least(x, 3).tolist() == [1, 1, 4, 4]
    assert least(x, 7).tolist() == []
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 100, np.uint64) * np.uint64(2))
    assert [i for _, lo, hi in ranges(h, 7) for i in range(lo, hi)] == list(range(100))


def test_windows_are_told_by_their_words():
    a, b = Words([b"a b c d e"]), Words([b"x a  b\nc d"])
    assert window_hashes(a.hashes(), 4)[0] == window_hashes(b.hashes(), 4)[1]
    assert window_hashes(a.hashes(), 3)[0] != window_hashes(a.hashes(), 3)[1]
    assert Words([b"ab"]).hashes()[0] != Words([b"ba"]).hashes()[0]
