"""The shared folder and the tables in it."""

import os
import subprocess
import sys

import pytest

from tarnlake import session

WITHOUT_A_FOLDER = """
from pyspark.sql import SparkSession
from tarnlake.session import materialize, shared_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert materialize(spark.range(5), "five").count() == 5
assert shared_dir(spark) == shared_dir(spark)
print("ran")
"""


def test_a_local_session_without_a_folder(tmp_path):
    """With an empty conf folder, nothing sets spark.checkpoint.dir."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", WITHOUT_A_FOLDER], env=env, capture_output=True, text=True, timeout=180, check=False)
    assert "ran" in done.stdout, done.stderr[-2000:]


def test_a_cluster_without_a_folder_is_an_error():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_freed_tables_are_gone(spark):
    t = session.materialize(spark.range(10).repartition(3), "ten")
    path = t._tarnlake_path.removeprefix("file:")
    assert t.count() == 10 and os.path.isdir(path)
    before = spark.conf.get(session.CLEANUP)
    session.free(t, None)
    assert not os.path.exists(path) and spark.conf.get(session.CLEANUP) == before
