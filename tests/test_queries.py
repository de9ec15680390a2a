"""Every query with SQL gives the rows of that SQL in DuckDB."""

import importlib
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.sql(f"create view {path.stem} as select * from '{path}'")
    return c


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@needs_data
@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n != "pipeline"))
def test_same_rows(spark, con, name):
    df, sql = entry.queries()[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*sql.columns).collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in sql.fetchall()), key=repr)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_training_data_operators(tmp_path):
    """The rest imports and registers its queries when that subpackage and the pipeline are gone."""
    import shutil

    root = Path(entry.__file__).parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "tidemark" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave
    code = "import __spark_entry__ as e; q = e.queries(); assert 'full_scan' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_them():
    root = Path(importlib.import_module("tidemark").__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tidemark.llm" not in path.read_text()
