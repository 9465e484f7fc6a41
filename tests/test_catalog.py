"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others give rows of a stable schema."""

import glob
import math
import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from loomstat.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(float(x)) if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f" else str(x)


def rows(pdf):
    return sorted(tuple(plain(x) for x in t) for t in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert contract.entry(spark).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())
    for sql in contract.oracle_sql().values():
        assert isinstance(sql, str)
        assert re.match(r"\s*(WITH|SELECT)\b", sql, re.I)


def test_goes_on_without_the_pipeline_operators(tmp_path):
    """A copy without their folders, with and without corpus_pipeline.py, still imports and has all other queries."""
    root = os.path.dirname(contract.__file__)
    shutil.copytree(f"{root}/loomstat", tmp_path / "loomstat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if os.path.exists(f"{root}/corpus_pipeline.py"):
        shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    for _ in range(2):
        says = subprocess.run([sys.executable, "-c", "import __spark_entry__ as c; print(len(c.queries()), len(c.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
        assert says.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))], says.stderr
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
