"""Every corpus query in a process whose Python workers cannot import the package: functions travel by value, broadcasts are plain."""

import os
import subprocess
import sys

import pytest

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "file://{here}/shared").config("spark.driver.memory", "3g").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")

def importable(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("litloom") is not None])], ["found"])

assert not spark.range(1).mapInArrow(importable, "found boolean").first()["found"]
from litloom.llm import decontam, registry
from litloom.llm.common import table
for name, query in registry.QUERIES.items():
    print(name, query(spark, {data!r}).count(), flush=True)
docs, bench = table(spark, {data!r}, "documents"), table(spark, {data!r}, "benchmark")
for f in (decontam.without_contaminated, decontam.without_spans):
    for limit in (decontam.BLOCK_BYTES, 20_000):
        print(f.__name__, f(docs, bench, block_bytes=limit).count(), flush=True)
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, here=tmp_path, data=DATA)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.splitlines()) == 18
