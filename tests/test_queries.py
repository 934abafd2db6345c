"""Every registered query of the library against its SQL, and the driver's contract."""

import os
import shutil
import subprocess
import sys

import pytest
from compare import SMALL, assert_same, connection

from tessella.plans import catalog


@pytest.fixture(scope="module")
def tables():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, tables, name):
    df = catalog.queries()[name](spark, SMALL)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert_same(df, sql, tables)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [["tessella/llm", "tests/llm"], ["tessella/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_the_rest_works_without_optional_parts(tmp_path, gone):
    """In a process of its own: the tree without these folders and files still registers all other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *[os.path.basename(g) for g in gone]))
    code = "import os, __spark_entry__ as e; assert e.__file__.startswith(os.getcwd()); q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op') for n in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=100, env=env)
    assert ran.returncode == 0, ran.stderr
    n, pipeline, operators = ran.stdout.split()
    assert int(n) >= len(catalog.queries()) and pipeline == "False" and operators == str("tessella/llm" not in gone and os.path.isdir(f"{root}/tessella/llm"))
