import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sentrymill.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
               .config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture(scope="session")
def make_files(spark):
    def make(tree, repo="r"):
        rows = [(repo, path, content) for path, content in tree.items()]
        return spark.createDataFrame(rows, "repo string, path string, content string")
    return make
