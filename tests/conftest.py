"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def make_session():
    from pyspark.sql import SparkSession

    from vacanta.session import tune

    spark = (
        SparkSession.builder.master("local[8]")
        .appName("vacanta-tests")
        .config("spark.sql.shuffle.partitions", os.environ.get("TEST_PARTITIONS", "4"))
        .config("spark.default.parallelism", os.environ.get("TEST_PARTITIONS", "4"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
