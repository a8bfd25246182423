"""Queries with Python kernels run from any folder."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
print("ROWS", __spark_entry__.queries()["mc_triangle"](spark, {data!r}).count())
print("AGAIN", __spark_entry__.queries()["quadrangle"](spark, {data!r}).count())
"""


def test_from_another_folder(tmp_path, sf_dir):
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, data=sf_dir)], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert "ROWS 100" in done.stdout and "AGAIN 25" in done.stdout, done.stderr[-2000:]
