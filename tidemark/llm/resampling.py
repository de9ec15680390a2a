"""Quality by importance resampling.

Words and pairs of neighbouring words are hashed into buckets. One model has the bucket shares of the target, texts
labelled good, the other those of all texts; a text's importance is the ratio of its probabilities under the two. Texts
are drawn without replacement by the Gumbel top-k trick: a Gumbel draw is added to each log importance and the largest
``keep`` share is kept, unless stated the share of good texts among the labelled ones.

The target model learns from at most ``sample`` labelled rows (SAMPLE unless given; the least hashes of the ids); the
model of all texts counts all of them. Draws are hashes of id and text, so reruns agree. The k-th largest score is found
by histograms that narrow down to it; rows that tie with it are kept.

Defined cases: null and empty texts have log importance 0; without good labels all log importances are 0; labels that
repeat an id count as their mean, good from one half; an empty table gives no rows; repeated rows stay, and equal rows
draw equally; extra columns stay, and columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import add_columns, documents, map_batches, stored
from tidemark.llm.words import Words, slices, window_hashes

BUCKETS = 1 << 14
SAMPLE = 20_000
SMOOTHING = 1.0
SEED = 9
BINS = 4096


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and each pair of words."""
    words = Words(texts)
    h = words.hashes()
    two = np.flatnonzero(words.window_starts(2))
    of = np.concatenate([words.doc, words.doc[two]])
    return of, (np.concatenate([h, window_hashes(h, 2)[two]]) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame, good: DataFrame, id_col: str, text: str) -> np.ndarray:
    """Row 0: how often each bucket occurs in all texts; row 1: in those of the at most SAMPLE ids of ``good``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for row, texts in slices(batch.column(0)):
                of, bucket = features(texts)
                target = np.asarray(batch.column(1).slice(row, len(texts)).to_pylist(), bool)
                total += [np.bincount(bucket, minlength=BUCKETS), np.bincount(bucket[target[of]], minlength=BUCKETS)]
        used = np.flatnonzero(total[0])
        yield pa.record_batch({"bucket": pa.array(used), "n": pa.array(total[0][used]), "target": pa.array(total[1][used])})

    marked = docs.select(id_col, text).join(F.broadcast(good.withColumn("_td_good", F.lit(True))), id_col, "left").select(text, F.coalesce("_td_good", F.lit(False)).alias("good"))
    rows = map_batches(marked, count, "bucket long, n long, target long").groupBy("bucket").agg(F.sum("n"), F.sum("target")).collect()
    out = np.zeros((2, BUCKETS))
    for bucket, n, target in rows:
        out[:, bucket] = n, target
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Log of the target's share over the share in all texts, for each bucket."""
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    every, target = counts + SMOOTHING
    return np.log(target / target.sum()) - np.log(every / every.sum())


def kth_largest(scores: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, from counts of value ranges only."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    while low is not None and low < high:
        place = F.least(F.floor((F.col(column) - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        bins = scores.where(F.col(column).between(low, high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for b in sorted(bins.collect(), key=lambda b: -b["bin"]):
            if k <= b["n"]:
                low, high = b["low"], b["high"]
                break
            k -= b["n"]
    return low


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, sample: int = SAMPLE, seed: int = SEED, id_col: str = "doc_id", text: str = "text", without: tuple[str, ...] = ()) -> DataFrame:
    """Each row with ``log_importance``, ``score`` and ``kept``; ``labels`` has the id and ``quality``, 1 for good.

    Scored rows are written once and read for the limit and the result; columns ``without`` are left out of them.
    """
    judged = labels.where("quality is not null").groupBy(id_col).agg((F.avg("quality") >= 0.5).alias("good"))
    if keep is None:
        keep = judged.agg(F.avg(F.col("good").cast("double"))).first()[0]
        keep = 1.0 if keep is None else keep
    # at most ``sample`` ids are broadcast
    good = judged.where("good").orderBy(F.xxhash64(id_col), id_col).limit(sample).select(id_col)
    ratio = log_ratio(bucket_counts(docs, good, id_col, text))
    shipped = docs.sparkSession.sparkContext.broadcast(ratio)

    def work(texts: list[bytes | None]) -> list[pa.Array]:
        of, bucket = features(texts)
        return [pa.array(np.bincount(of, shipped.value[bucket], len(texts)).astype(np.float64))]

    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text), 11) + 0.5) * 2.0**-53
    own = docs.drop("score", "kept")
    weighed = add_columns(own, text, "log_importance double", work).withColumn("score", F.col("log_importance") - F.log(-F.log(draw)))
    weighed = stored(weighed.drop(*without))
    k = round(keep * weighed.count())
    least = kth_largest(weighed, "score", k) if k else float("inf")
    return weighed.withColumn("kept", F.col("score") >= F.lit(least) if least is not None else F.lit(False))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), without=("text",))
