"""The driver's entry points, also in a copy without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).parents[1]
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *e.queries())"


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("loomtext/llm", "tests/llm", "corpus_pipeline.py"), ("loomtext/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_queries_without_the_training_data_folders(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-800:]
    names = said.stdout.split()[2:]
    assert "bayes_count_scores" in names and "pipeline" not in names
    assert any(n.startswith("op1_") for n in names) == ((copy / "loomtext/llm").exists())


def test_the_flagship_query_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
