"""The registered queries against DuckDB on the smallest tables, and the entry point without the optional subpackage."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from vicinal.plans import queries as own

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@needs_data
@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = own.queries()[name](spark, DATA)
    want = con.sql(own.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    places = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=str)


@needs_data
def test_rows_only(spark):
    assert own.queries()["final_rows"](spark, DATA).columns == own.queries()["hyper_all"](spark, DATA).columns
    assert own.queries()["distance_export"](spark, DATA).columns == ["gene_1", "gene_2", "pair", "distance"]
    assert own.queries()["kde_mode"](spark, DATA).columns == ["gene_A", "gene_B", "mode"]


def test_without_optional_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hyper_all' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "r")})
