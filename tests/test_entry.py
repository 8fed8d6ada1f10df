"""The driver's module where the corpus operators have been deleted."""

import os
import shutil
import subprocess
import sys

import pytest

REPOSITORY = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_import_without_corpus_operators(tmp_path, pipeline):
    ignored = shutil.ignore_patterns(".git", "llm", "tests", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    copy = shutil.copytree(REPOSITORY, tmp_path / "copy", ignore=ignored)
    told = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as d; print(len(d.queries()), len(d.oracle_sql()), *d.queries())"],
        cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"})
    assert told.returncode == 0, told.stderr
    queries, sql, *names = told.stdout.split()
    assert queries == sql and not [n for n in names if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
