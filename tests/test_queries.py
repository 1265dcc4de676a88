"""Every query with SQL of its own gives the same rows in DuckDB; the entry module stands without its optional parts."""

import importlib
import json
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    own = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})")
    assert own == sorted((tuple(map(normal, r)) for r in result.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_optional_parts_can_be_missing(tmp_path):
    import shutil

    root = Path(entry.__file__).parent
    shutil.copytree(root / "strandex", tmp_path / "strandex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, json; print(json.dumps([list(e.queries()), list(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    queries, sql = json.loads(out.splitlines()[-1])
    assert queries and set(sql) <= set(queries) and not any(q.startswith("op") or q == "pipeline" for q in queries)


def test_nothing_else_imports_the_optional_part():
    root = Path(importlib.import_module("strandex").__file__).parent
    for file in root.rglob("*.py"):
        if "llm" not in file.parts:
            assert "llm" not in file.read_text().replace("LLM", ""), file
