"""Streams in a session that others built, from a folder without the library."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
RUN = """
import sys
from pyspark.sql import SparkSession
root, name, shared = sys.argv[1:]
sys.path.insert(0, root)
import __spark_entry__ as contract
spark = SparkSession.builder.config(map={
    "spark.master": "local[4]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4",
    "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": shared}).getOrCreate()
provider = "spark.sql.streaming.stateStore.providerClass"
before = spark.conf.get(provider)
table = contract.queries()[name](spark, "/root/testdata/sf0.001")
assert spark.conf.get(provider) == before
print("rows", *sorted(map(tuple, table.collect())), sep="\\n")
"""


@pytest.mark.parametrize("name", ["feature_lookup"])
def test_a_stream_needs_no_session_of_the_library(spark, rows, tmp_path, name):
    import __spark_entry__ as contract

    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", RUN, str(ROOT), f"{name}_stream", str(tmp_path / "s")],
                           cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    assert found.returncode == 0, found.stderr[-3000:]
    table = contract.queries()[name](spark, "/root/testdata/sf0.001")
    expected = sorted(map(tuple, table.collect()))
    assert found.stdout.partition("rows\n")[2].splitlines() == [str(row) for row in expected]
