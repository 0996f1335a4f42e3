"""Every registered form query against its DuckDB twin."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import SF, duck_rows, rows

from quillgrid.plans import registry


def test_every_query_has_a_twin():
    assert registry.queries().keys() == registry.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_twin(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns, wanted = duck_rows(duck, registry.oracle_sql()[name])
    assert sorted(df.columns) == columns
    assert rows(df) == wanted


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_part(tmp_path, pipeline):
    root = Path(registry.__file__).parents[2]
    shutil.copytree(root / "quillgrid", tmp_path / "quillgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if pipeline and (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    path = os.pathsep.join([str(tmp_path), *(p for p in sys.path if Path(p or ".").resolve() != root)])
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True)
    assert said.stdout.split()[-2:] == [str(len(registry.queries())), str(len(registry.oracle_sql()))], said.stderr
