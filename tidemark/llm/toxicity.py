"""Toxicity by a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios.

A text is lowered and its white space made single-character spaces; its n-grams of 3 to 6 characters are hashed. Each
n-gram's presence counts as the log ratio of its smoothed shares among toxic and other texts, and a logistic regression
with an L2 penalty weighs these. N-grams with a ratio near 0 or in few texts are left out.

Fitted on the driver from at most ``sample`` labelled rows (SAMPLE unless given; the least hashes of the ids, so reruns
agree) with whole texts of at most ``sample_bytes`` in all (SAMPLE_BYTES unless given; rows by hash as long as they fit);
scores cover every whole text. Defined cases: null and empty texts have no n-grams and get the intercept's score;
null labels are skipped; labels that repeat an id count as their mean, toxic from one half; without a labelled row of
either class all scores are the share of toxic labels, or 0; repeated rows stay; extra columns stay, and columns named
like an added one are replaced. Memory is that of a few MB of text, or about 60 times the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import add_columns, documents, stored
from tidemark.llm.words import mix, slices

ORDERS = (3, 4, 5, 6)
#: Bits of the n-gram hashes, and labelled rows to learn from.
BITS = 20
SAMPLE, SAMPLE_BYTES = 6_000, 48 << 20
#: Text bytes that the driver takes apart at once.
FIT_BYTES = 1 << 18
LEAST_RATIO, LEAST_TEXTS, PENALTY, SMOOTHING = 2.0, 4, 1e-3, 1.0
FOLDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = {c: " " for c in (*range(0x09, 0x0E), 0x85, 0xA0)}


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that labels aren't learned from."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def ngrams(texts: list[bytes | None], useful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-grams of each text, of the useful hashes alone if given; sorted."""
    lowered = [f" {(t or b'').decode().lower().translate(_SPACES)} " for t in texts]
    size = np.fromiter(map(len, lowered), np.int64, len(lowered))
    chars = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    pairs, h = [], chars
    for n in range(2, max(ORDERS) + 1):
        h = h[: max(0, len(chars) - n + 1)] * _BASE + chars[n - 1 :]
        if n not in ORDERS:
            continue
        key = (mix(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)
        keep = of[: len(key)] == of[n - 1 :]
        if useful is not None:
            keep &= useful[key]
        at = np.flatnonzero(keep)
        pairs.append(of[at].astype(np.int64) << BITS | key[at])
    pairs = np.sort(np.concatenate(pairs))
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])[: len(pairs)]]
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    weight: np.ndarray
    intercept: float

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        of, key = ngrams(texts, self.weight != 0)
        return _sigmoid(self.intercept + np.bincount(of, self.weight[key], len(texts)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(texts: list[bytes | None], toxic: np.ndarray, rounds: int = 300) -> Model:
    size = 1 << BITS
    if not len(toxic) or toxic.all() or not toxic.any():
        share = float(np.clip(toxic.mean() if len(toxic) else 0, 1e-9, 1 - 1e-9))
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))

    def parts() -> Iterator[tuple[int, list[bytes | None]]]:
        return slices(pa.array(texts, pa.large_binary()), FIT_BYTES)

    count = np.zeros((2, size))
    for row, part in parts():
        of, key = ngrams(part)
        for label in (0, 1):
            count[label] += np.bincount(key[toxic[row + of] == label], minlength=size)
    share = count + SMOOTHING
    ratio = np.log(share[1] / share[1].sum()) - np.log(share[0] / share[0].sum())
    useful = (np.abs(ratio) >= LEAST_RATIO) & (count.sum(0) >= LEAST_TEXTS)
    rows, keys = [], []
    for row, part in parts():
        of, key = ngrams(part, useful)
        rows.append((row + of).astype(np.int32))
        keys.append(key.astype(np.int32))
    used, column = np.unique(np.concatenate(keys), return_inverse=True)
    column = column.astype(np.int32)
    if not len(used):
        return Model(np.zeros(size, np.float32), float(np.log(toxic.mean() / (1 - toxic.mean()))))
    row, value = np.concatenate(rows), ratio[used][column]
    n, y = len(texts), toxic.astype(float)
    by_column = np.argsort(column, kind="stable")
    row_first, column_first = np.flatnonzero(np.diff(row, prepend=-1)), np.flatnonzero(np.diff(column[by_column], prepend=-1))
    held, column_row, column_value = row[row_first], row[by_column], value[by_column]

    def times(vector: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[held] = np.add.reduceat(value * vector[column], row_first)
        return out

    def transposed(vector: np.ndarray) -> np.ndarray:
        return np.add.reduceat(column_value * vector[column_row], column_first)

    # accelerated gradient descent; the step is the reciprocal of a bound on the curvature
    vector = np.ones(len(used))
    for _ in range(20):
        vector = transposed(times(vector))
        top = np.linalg.norm(vector) or 1.0
        vector /= top
    step = 1 / (0.3 * (top + n) / n + PENALTY)
    w = before = np.zeros(len(used))
    b = b_before = float(np.log(y.mean() / (1 - y.mean())))
    for i in range(rounds):
        speed = i / (i + 3)
        v, c = w + speed * (w - before), b + speed * (b - b_before)
        off = (_sigmoid(c + times(v)) - y) / n
        before, b_before = w, b
        w = v - step * (transposed(off) + PENALTY * v)
        b = c - step * off.sum()
    weight = np.zeros(size, np.float32)
    weight[used] = w * ratio[used]
    return Model(weight, float(b))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text: str = "text") -> Model:
    """A model from labelled rows that aren't held out; ``labels`` has the id and ``toxic``."""
    chosen = labels.where(F.col("toxic").isNotNull() & ~held_out(id_col)).groupBy(id_col).agg((F.avg("toxic") >= 0.5).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    # at most ``sample`` rows are broadcast
    found = docs.select(id_col, text).join(F.broadcast(chosen), id_col).select(F.col(text).alias("text"), "toxic", F.xxhash64(id_col, text).alias("draw"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"))
    found = stored(found)
    # sizes come to the driver first, and then only the texts that fit
    cut, held = None, 0
    for row in found.select("draw", "size").orderBy("draw").limit(sample).collect():
        held += row["size"]
        if held > sample_bytes:
            break
        cut = row["draw"]
    rows = found.where(F.col("draw") <= F.lit(cut).cast("long")).orderBy("draw").select("text", "toxic").limit(sample).toArrow()
    text = "text"
    return fit(rows.column(text).cast(pa.large_binary()).to_pylist(), np.array(rows.column("toxic").to_pylist(), bool))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Each row with ``score`` in 0 to 1 and ``predicted``, 1 from one half."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        p = shipped.value.score(texts)
        return [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]

    return add_columns(docs, text, "score double, predicted int", work)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
