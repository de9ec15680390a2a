import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import clashing, empty, odd_docs, words
from tidemark.llm.resampling import BUCKETS, bucket_counts, features, kth_largest, op9_importance_resampling, resample


def corpus(n=300):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        good = i % 5 != 0
        pick = (lambda: f"good{int(rng.random() ** 3 * 60)}") if good else (lambda: f"junk{rng.randrange(40)}")
        rows.append((i, " ".join(pick() for _ in range(rng.randint(20, 90))), int(good)))
    return rows


@pytest.fixture
def tables(spark):
    rows = corpus()
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "doc_id long, quality int")


def test_good_texts_are_kept(spark, tables):
    docs, labels = tables
    out = resample(docs, labels).collect()
    share = sum(r[2] for r in corpus() if r[0] % 2) / 150
    assert abs(sum(r.kept for r in out) - share * 300) <= 1
    assert sum(r.kept != (r.doc_id % 5 != 0) for r in out) <= 6


def test_log_importance_is_the_ratio_of_the_models(spark, tables):
    docs, labels = tables
    good = labels.where("quality = 1").select("doc_id")
    counts = bucket_counts(docs, good, "doc_id", "text")
    rows = {r.doc_id: r.text for r in docs.collect()}
    raw, target = Counter(), Counter()
    for i, text in rows.items():
        bag = Counter(features([text.encode()])[1].tolist())
        assert sum(bag.values()) == 2 * len(words(text)) - 1
        raw += bag
        target += bag if i % 2 and i % 5 else Counter()
    assert {b: n for b, n in enumerate(counts[0]) if n} == raw and {b: n for b, n in enumerate(counts[1]) if n} == target
    n_raw, n_target = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    want = sum(math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in features([rows[7].encode()])[1].tolist())
    assert resample(docs, labels).where("doc_id = 7").first().log_importance == pytest.approx(want)


def test_kth_largest(spark):
    values = [random.Random(1).choice([1.5, -3.0, 1e9, 7.25, 0.1 * i]) for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    for k in (1, 2, 77, 250, 499, 500):
        assert kth_largest(df, "score", k) == sorted(values, reverse=True)[k - 1]


@pytest.mark.parametrize("keep", [0.0, 0.3, 1.0])
def test_share_kept_and_reruns(spark, tables, keep):
    docs, labels = tables
    out = resample(docs, labels, keep)
    kept = sorted(r.doc_id for r in out.where("kept").collect())
    assert len(kept) == round(300 * keep)
    assert kept == sorted(r.doc_id for r in resample(docs.repartition(5), labels, keep).where("kept").collect())


def test_odd_documents(spark):
    docs = clashing(odd_docs(spark))
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 1), (15, 0), (None, 1), (5, None)], "doc_id long, quality int")
    out = resample(docs, labels)
    assert out.count() == docs.count() and out.where("text is null or text = ''").where("log_importance <> 0").count() == 0
    assert [c for c in out.columns if c in ("log_importance", "score", "kept")] == ["log_importance", "score", "kept"]
    none = labels.limit(0)
    assert resample(docs, none).where("not kept or log_importance <> 0").count() == 0
    assert resample(empty(docs), labels).count() == 0


def test_gumbel_draws(spark):
    """Among texts of equal importance each is kept equally often."""
    docs = spark.createDataFrame([(i, "same text") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    kept = [frozenset(r.doc_id for r in resample(docs, labels, 0.5, seed=s).where("kept").collect()) for s in range(4)]
    assert all(len(k) == 50 for k in kept) and len(set(kept)) == 4


def test_query(spark, tables, tmp_path):
    docs, labels = tables
    docs.withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert op9_importance_resampling(spark, str(tmp_path)).count() == 300
