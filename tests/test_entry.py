"""The entry points with and without the training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql())); print(callable(e.entry))"


@pytest.mark.parametrize("gone", [["folioloom/llm", "tests/llm", "corpus_pipeline.py"], ["folioloom/llm", "tests/llm"]])
def test_entry_points_without_the_training_data_part(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json", "*.md"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        elif (copy / name).exists():
            (copy / name).unlink()
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert not said.returncode, said.stderr
    names, with_sql, callable_entry = said.stdout.splitlines()[-3:]
    assert "bm25_topk" in names.split() and "pipeline" not in names.split()
    assert not any(n.startswith("op1_") for n in names.split())
    assert set(with_sql.split()) <= set(names.split()) and callable_entry == "True"


def test_every_query_has_a_name_and_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
