"""Each query with SQL gives what DuckDB gives; the training-data operators can be taken out."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quern.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(DATA).exists():
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    expected = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*[f"`{c}`" for c in cols]).collect()))) == sorted(map(repr, expected))


def test_entry_without_the_training_data_operators(tmp_path):
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 60 and not any(x.startswith('op') for x in n), n; assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
