"""The queries run wherever the session was started."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
sys.path.remove(sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
print("rows", entry.queries()["daily_hours_stream"](spark, "/root/testdata/sf0.001").count())
"""


def test_executors_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0 and int(run.stdout.split("rows ")[1]) > 0, run.stderr[-2000:]
