import subprocess
import sys


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(o) <= set(q); from pyspark.sql import SparkSession; assert SparkSession.getActiveSession() is None"
    assert subprocess.run([sys.executable, "-c", code], timeout=120).returncode == 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
