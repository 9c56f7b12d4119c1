"""Every registered query of the library's own operators against its SQL."""

from __future__ import annotations

import pytest

from heddle.plans import registry
from tests.compare import compare, connect
from tests.conftest import MIDDLE, SMALL

QUERIES, SQL = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.fixture(scope="module")
def larger():
    return connect(MIDDLE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, SQL[name]) == ""


@pytest.mark.parametrize("name", ["flagship_broad_ranking", "w01_w02_sens_metric", "m10_j15_residual_disease_drug", "m16_enrichment_score"])
def test_same_rows_at_larger_size(spark, larger, name):
    assert compare(QUERIES[name](spark, MIDDLE), larger, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and {r["rank"] for r in rows} == set(range(1, 16))
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_optional_parts(tmp_path):
    """The entry imports and keeps its queries when the llm subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "heddle", tmp_path / "heddle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), any(n.startswith('op1_') or n == 'pipeline' for n in q))"
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "JAVA_HOME": ""}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(QUERIES) and int(out[1]) == len(SQL) and out[2] == "False"
