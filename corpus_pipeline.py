"""The corpus pipeline: quality rules, near duplicates, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run() writes what a stage
returns to the shared folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, neardup, quality, substring
from tidemark.llm.shared import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules or whose posterior quality is below one half go."""
    return quality.score_quality(docs, only_kept=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays, the one with the least id; rows share a class by their own texts only."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        copies = neardup.near_duplicates(docs).where("class_id <> id").select(F.col("id").alias("doc_id"))
        return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    # ids that repeat or are null don't name rows: rows are numbered once, in a table that is written
    rows = stored(docs.withColumn("_td_row", F.monotonically_increasing_id()))
    classes = neardup.near_duplicates(rows, id_col="_td_row").withColumnRenamed("id", "_td_row")
    of = rows.select("_td_row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_td_row").alias("order")).join(classes, "_td_row")
    first = of.groupBy("class_id").agg(F.min("order").alias("first")).select(F.col("first._td_row").alias("_td_row"))
    return rows.join(first, "_td_row", "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from the texts that have them; other texts stay as they are."""
    cut = substring.dedup_substrings(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)}
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it."""
    return mixing.apply_mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row, as counts and digests."""
    return bpe.token_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: Expectation-maximisation, signatures and merges can't be told in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
