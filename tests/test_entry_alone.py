"""The repository without the text operators: the entry module imports and its queries run."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert "pipeline" not in names and "flagship" in names and set(sql) <= set(names)
assert not any(n.startswith("op") and n[2].isdigit() for n in names)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert names["ohlc_bars_4h"](spark, "/root/testdata/sf0.001").count() > 0 and names["alias_rewrite"](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_entry_without_text_operators(tmp_path):
    for keep_pipeline in (True, False):
        copy = tmp_path / f"copy-{keep_pipeline}"
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "spark-warehouse", *([] if keep_pipeline else ["corpus_pipeline.py"])))
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr
