"""The library without its llm folders: the entry imports, and every other query is there."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TRY = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession

names = set(entry.queries())
assert not [n for n in names if n[:2] == "op" and n[2:3].isdigit() or n == "pipeline"] and set(entry.oracle_sql()) <= names and len(names) > 120, names
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", entry.entry(spark).count())
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_llm(tmp_path, pipeline):
    """With and without the pipeline's module, which the folders leave behind."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "__pycache__") or (n == "corpus_pipeline.py" and not pipeline)])
    assert not (copy / "lynceus/llm").exists() and (copy / "corpus_pipeline.py").exists() == pipeline
    code = TRY if not pipeline else TRY.split("spark =")[0]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=env, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert pipeline or int(done.stdout.split("rows")[-1]) > 0
