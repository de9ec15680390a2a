import os

import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import odd_docs, rows_of
from tidemark.llm import shared
from tidemark.llm.words import slices


def test_stored_tables_are_in_the_shared_folder_and_can_be_cleared(spark):
    docs = odd_docs(spark)
    a, b = shared.stored(docs), shared.stored_by(docs.withColumn("k", F.lit(1)), "k", 3)
    assert rows_of(a, *docs.columns) == rows_of(b, *docs.columns) == rows_of(docs, *docs.columns)
    folder = shared.session_dir(spark)
    assert folder.startswith(shared.shared_dir(spark)) and len(os.listdir(folder)) >= 2
    # grouping by the key of a clustered table doesn't shuffle it
    assert "Exchange" not in b.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    shared.clear(spark)
    assert not os.path.exists(folder) and not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_")]


def test_shuffled_rows_are_written_before_they_are_numbered(spark):
    docs = odd_docs(spark)
    assert shared.steady(docs) is docs
    mixed = shared.steady(docs.repartition(3))
    assert "Exchange" not in mixed._jdf.queryExecution().executedPlan().toString() and rows_of(mixed, *docs.columns) == rows_of(docs, *docs.columns)


def test_slices():
    values = [b"abc", None, b"", b"x" * 50, b"y", "é".encode(), None]
    array = pa.array([v.decode() if v is not None else None for v in values], pa.string())
    for most in (1, 3, 4, 60):
        got = list(slices(array, most))
        assert [v for _, part in got for v in part] == values
        assert [row for row, _ in got] == [sum(len(p) for _, p in got[:i]) for i in range(len(got))]
        assert all(len(part) == 1 or sum(len(v or b"") for v in part) <= most for _, part in got)
    assert list(slices(array.slice(3, 2), 1)) == [(0, [b"x" * 50]), (1, [b"y"])]
    assert list(slices(pa.array([], pa.string()))) == []
