"""The driver's contract: queries match their SQL, and everything but ``llm`` works without it."""

import os
import subprocess
import sys

import pytest

import __spark_entry__

CHECKED = ["summary_numeric", "stratified_categorical", "categorical_display_row", "relationship_summary", "population_overlap", "drift_categorical", "transition_counts", "panel_change", "linkage_decisions"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    df = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()))) == sorted(map(str, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 8


def test_works_without_the_subpackage(tmp_path):
    import shutil

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/tallyforge", tmp_path / "tallyforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(q.startswith('op') or q == 'pipeline' for q in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_suite_works_without_the_subpackage(tmp_path):
    """In a copy without both folders of the subpackage and the pipeline all tests are collected and some are run."""
    import shutil

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for folder in ("tallyforge", "tests"):
        shutil.copytree(f"{root}/{folder}", tmp_path / folder, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(f"{root}/{name}", tmp_path)
    run = lambda *a: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *a], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True)
    run("--collect-only", "tests")
    run("tests/test_statistics.py", "-k", "fisher_is_exact or shapiro or distinct")
