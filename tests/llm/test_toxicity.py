import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import clashing, empty, odd_docs
from tidemark.llm import toxicity
from tidemark.llm.toxicity import BITS, LEAST_RATIO, LEAST_TEXTS, PENALTY, SMOOTHING, Model, fit, held_out, learn, ngrams, op4_toxicity, score_toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "tarnish velour mopping quill".split() for b in ("ed", "ing", "s", "")]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grobnik", "Grobniks", "zumpf"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


@pytest.fixture
def tables(spark):
    rows = corpus(400)
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    out = score_toxicity(docs, learn(docs, labels)).join(labels, "doc_id").where(held_out()).collect()
    assert len(out) > 40 and all(r.predicted == r.toxic for r in out)
    assert min(r.score for r in out if r.toxic) > max(r.score for r in out if not r.toxic)


def test_held_out_labels_are_not_learned_from(spark, tables):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "if(crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = learn(docs, labels), learn(docs, flipped)
    assert (a.weight == b.weight).all() and a.intercept == b.intercept
    assert [r.doc_id for r in docs.where(held_out()).collect()] == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]


def plain_scores(rows, asked):
    """The model told slowly: n-grams as strings, and the penalised likelihood's optimum by Newton's steps."""

    def grams(text):
        s = " " + text.lower() + " "
        return {s[i : i + n] for n in (3, 4, 5, 6) for i in range(len(s) - n + 1)}

    sets, y = [grams(t) for _, t, _ in rows], np.array([label for *_, label in rows], float)
    counts = [Counter(g for s, label in zip(sets, y, strict=True) if label == which for g in s) for which in (0, 1)]
    every = [sum(c.values()) + (1 << BITS) * SMOOTHING for c in counts]
    ratio = {g: np.log((counts[1][g] + SMOOTHING) / every[1]) - np.log((counts[0][g] + SMOOTHING) / every[0]) for g in counts[0] | counts[1]}
    used = sorted(g for g, r in ratio.items() if abs(r) >= LEAST_RATIO and counts[0][g] + counts[1][g] >= LEAST_TEXTS)
    x = np.array([[ratio[g] * (g in s) for g in used] + [1.0] for s in sets])
    w, ridge = np.zeros(len(used) + 1), np.diag([PENALTY] * len(used) + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        slope, curve = x.T @ (p - y) / len(y) + ridge @ w, (x.T * (p * (1 - p))) @ x / len(y) + ridge + np.eye(len(w)) * 1e-12
        w -= np.linalg.solve(curve, slope)
    found = [np.array([ratio[g] * (g in grams(t)) for g in used] + [1.0]) @ w for t in asked]
    return 1 / (1 + np.exp(-np.array(found)))


def test_scores_match_a_plain_model():
    rows = corpus(120, 7)
    # some labels are wrong, so that the optimum isn't at the end of the scale
    rows = [(i, t, 1 - y if i % 9 == 0 else y) for i, t, y in rows]
    asked = [t for _, t, _ in corpus(40, 8)] + ["", "grobnik", "velour zumpf"]
    model = fit([t.encode() for _, t, _ in rows], np.array([bool(y) for *_, y in rows]), rounds=4000)
    got, want = model.score([t.encode() for t in asked]), plain_scores(rows, asked)
    assert np.abs(got - want).max() < 0.01 and 0.1 < want.std()


def test_sample_bytes_bound_what_the_driver_gets(spark, tables, monkeypatch):
    docs, labels = tables
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append(sum(map(len, texts))))
    for most in (0, 10_000, 1 << 30):
        learn(docs, labels, sample_bytes=most)
    assert seen[0] == 0 and 5_000 < seen[1] <= 10_000 < seen[2]


def test_ngrams_are_those_of_each_text():
    texts = ["Abc abc", "", None, "日本語 é", "c abc"]
    data = [t.encode() if t is not None else None for t in texts]
    of, key = ngrams(data)
    alone = [set(ngrams([d])[1].tolist()) for d in data]
    assert [set(key[of == i].tolist()) for i in range(len(texts))] == alone
    expected = {g for n in (3, 4, 5, 6) for g in [" abc abc "[i : i + n] for i in range(10 - n)]}
    assert len(alone[0]) == len(expected)


def test_null_and_empty_texts_and_columns(spark):
    model = Model(np.ones(1 << BITS, np.float32), -1.0)
    docs = clashing(odd_docs(spark))
    out = score_toxicity(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[6].score == pytest.approx(1 / (1 + np.e)) and rows[6].predicted == 0 and rows[12].predicted == 1
    assert score_toxicity(empty(docs), model).count() == 0


def test_without_both_classes():
    assert fit([], np.zeros(0, bool)).score([b"x"])[0] < 1e-6
    assert fit([b"a", b"b"], np.array([True, True])).score([b"x"])[0] > 0.99
    assert fit([b"a", b"b"], np.array([True, False])).score([b"x"])[0] == pytest.approx(0.5)


def test_labels_that_repeat_or_are_null(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None) for i in range(20)] + [(1, 1), (1, 0), (None, 1)], "doc_id long, toxic int")
    assert np.isfinite(learn(docs, labels).intercept)


def test_sample_bound(spark, tables, monkeypatch):
    docs, labels = tables
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append(len(texts)))
    learn(docs, labels, sample=7)
    assert seen == [7]


def test_query(spark, tables, tmp_path):
    docs, labels = tables
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = op4_toxicity(spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 400
