"""Scratch folders without any setting, in a session of their own."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from pyspark.sql import SparkSession
from flowlucid.config import scratch_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
a, b = scratch_dir(spark, "x"), scratch_dir(spark, "x")
assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]
assert scratch_dir(spark, "x", "/shared/").startswith("/shared/x-")
spark.range(3).write.parquet(a)
assert spark.read.parquet(a).count() == 3
"""


def test_without_settings(tmp_path):
    root = Path(__file__).resolve().parents[1]
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
