"""The entry loads without a session, also where PySpark lies in its zip file."""

import glob
import os
import subprocess
import sys

import pyspark
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; from pyspark import SparkContext; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q) and SparkContext._active_spark_context is None; print(len(q))"


@pytest.mark.parametrize("zipped", [False, True])
def test_entry_loads_without_a_session(zipped):
    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    zips = glob.glob(f"{lib}/pyspark.zip") + glob.glob(f"{lib}/py4j-*.zip") if zipped else []
    if zipped and not zips:
        pytest.skip("this installation has no zip file")
    env = os.environ | {"PYTHONPATH": os.pathsep.join([*zips, ROOT])}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 60
