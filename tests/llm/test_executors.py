"""Every query where executors don't have the package: workers start in an empty folder,
and only the driver's path leads here."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
def found(_):
    try:
        import verbarium
        return ["yes"]
    except ImportError:
        return ["no"]
assert spark.sparkContext.parallelize([1], 1).mapPartitions(found).collect() == ["no"]
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        try:
            print("RAN", name, query(spark, "/root/testdata/sf0.001").count())
        except Exception as e:
            print("FAILED", name, str(e)[:300].replace(chr(10), " "))
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_without_the_package(tmp_path):
    path = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT)
    run = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, timeout=900)
    lines = [x for x in run.stdout.splitlines() if x.startswith(("RAN", "FAILED"))]
    assert lines and not [x for x in lines if x.startswith("FAILED")], (lines, run.stderr[-2000:])
    assert len(lines) >= 14
