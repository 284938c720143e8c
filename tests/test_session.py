"""Scratch folders where nothing is configured."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from folioflow.session import build_session, settle, scratch_root
spark = build_session("plain", "local[1]", 1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert settle(spark.range(3), "t").count() == 3 and scratch_root(spark) == scratch_root(spark)
print("fine")
"""


def test_local_session_without_configuration(tmp_path):
    """A local session with an empty configuration folder writes its tables to a folder of its own."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", CODE], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "fine" in out.stdout, out.stderr[-2000:]


CLEAN = """
import glob, os, time
from folioflow.session import build_session, settle
spark = build_session("clean", "local[2]", 4)
name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
before = spark.conf.get(name, None)
rows = settle(spark.range(10000).repartition(4, "id"), "t")
assert spark.conf.get(name, None) == before
shuffles = lambda: glob.glob(os.environ["SPARK_LOCAL_DIRS"] + "/**/shuffle_*.data", recursive=True)
until = time.time() + 5
while shuffles() and time.time() < until:
    time.sleep(0.2)
print("left", len(shuffles()))
assert rows.count() == 10000
"""


def test_settle_leaves_no_shuffle_files(tmp_path):
    """What a written table was shuffled by goes when it is written, not when the driver collects its garbage."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT, "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    out = subprocess.run([sys.executable, "-c", CLEAN], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "left 0" in out.stdout, out.stdout[-500:] + out.stderr[-2000:]


STREAM = """
import glob, os, time
from folioflow.session import build_session
from folioflow.streaming.runner import read_landed, run_each
spark = build_session("clean", "local[2]", 4)
name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
before = spark.conf.get(name, None)
spark.range(1000).write.parquet("landed")
stream = read_landed(spark, os.path.abspath("landed"), spark.range(1).schema)
run_each(stream, lambda batch, epoch: batch.repartition(4, "id").write.mode("overwrite").parquet(os.path.abspath("out")), "append", "t")
assert spark.conf.get(name, None) == before
shuffles = lambda: glob.glob(os.environ["SPARK_LOCAL_DIRS"] + "/**/shuffle_*.data", recursive=True)
until = time.time() + 5
while shuffles() and time.time() < until:
    time.sleep(0.2)
print("left", len(shuffles()))
assert spark.read.parquet("out").count() == 1000
"""


def test_stream_batches_leave_no_shuffle_files(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT, "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    out = subprocess.run([sys.executable, "-c", STREAM], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "left 0" in out.stdout, out.stdout[-500:] + out.stderr[-2000:]
