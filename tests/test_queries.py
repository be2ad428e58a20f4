"""The catalogue against DuckDB, and the plans it gets."""

import glob
import os

import pandas as pd
import pytest

from climekin import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1.5e-6)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark):
    from climekin import search

    f, r = queries._xy(spark, DATA)
    o = {"coord_type": "projected", "focal_id": "id", "ref_id": "id"}
    grid = plan_of(search(f, r, "count", max_geog=2.0, plan="grid", **o))
    assert "BroadcastHashJoin" in grid and "NestedLoop" not in grid
    assert "WindowGroupLimit" in plan_of(search(f, r, "knn_geog", 0.5, k=3, plan="grid", **o))
    read = plan_of(queries.QUERIES["all_xy_nodist"](spark, DATA)).split("ReadSchema: ")[-1]
    assert "embedding" in read and "label" not in read.splitlines()[0]


@pytest.mark.parametrize("name", ["knn_geog_unfiltered_ll", "knn_clim_unfiltered_xy", "knn_default_k"])
def test_unfiltered_neighbours_join_by_cells(spark, name):
    plan = plan_of(queries.QUERIES[name](spark, DATA)).split("== Physical Plan ==")[-1]
    assert "Join" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_entry_without_llm(tmp_path):
    """The library and its entry without the corpus operators, in a process of its own."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    assert not (copy / "climekin" / "llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(e.oracle_sql()) <= set(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(queries.QUERIES)), "True", "False"]
