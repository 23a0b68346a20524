"""The driver's contract."""

import subprocess
import sys

ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) >= 60; from pyspark import SparkContext; assert SparkContext._active_spark_context is None"


def test_imports_without_a_session():
    """Queries and SQL can be listed before Spark runs."""
    done = subprocess.run([sys.executable, "-c", ASK], capture_output=True, text=True, timeout=100)
    assert done.returncode == 0, done.stderr[-2000:]
