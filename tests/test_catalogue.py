import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from kelpline.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_its_sql(agrees, name):
    agrees(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_is_repeatable(spark, sf_dir, name):
    a, b = (sorted(map(tuple, catalogue.QUERIES[name](spark, sf_dir).collect())) for _ in range(2))
    assert a and a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [["kelpline/llm", "tests/llm"], ["kelpline/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_training_data_folders(tmp_path, gone):
    repo = Path(entry.__file__).parent
    shutil.copytree(repo, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet", "spark-warehouse"))
    for name in gone:
        own = tmp_path / "copy" / name
        shutil.rmtree(own, ignore_errors=True) if own.is_dir() else own.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) >= len(catalogue.QUERIES)
