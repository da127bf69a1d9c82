import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("logspark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from logspark import prepare

    yield prepare(session)
    session.stop()


@pytest.fixture
def lines(spark):
    """Lines of one file, numbered from 1."""

    def make(*texts, file="f"):
        rows = [(file, n, text) for n, text in enumerate(texts, 1)]
        return spark.createDataFrame(rows, "file string, line_no bigint, line string")

    return make


@pytest.fixture
def write(tmp_path):
    """Write a log file and return its path."""

    def make(*texts, name="app.log", data=None):
        path = tmp_path / name
        path.write_bytes(data if data is not None else ("\n".join(texts) + "\n").encode())
        return str(path)

    return make
