"""The driver's entry with and without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent

LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def listed(root):
    out = subprocess.run([sys.executable, "-c", LIST], cwd=root, capture_output=True, text=True, check=True)
    return out.stdout.split()


def test_entry_works_without_the_training_data_folders(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse")
    without = shutil.copytree(REPO, tmp_path / "without", ignore=skip)
    queries, sql, pipeline = listed(without)
    assert queries == sql and int(queries) > 60 and pipeline == "False"
    (without / "corpus_pipeline.py").unlink()
    assert listed(without) == [queries, sql, "False"]
