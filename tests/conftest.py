from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

TESTDATA = "/root/testdata"

LINEITEM = (
    "l_returnflag string, l_linestatus string, l_quantity double, "
    "l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"
)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def set_option(key, value):
        before.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield set_option
    for key, value in before.items():
        spark.conf.set(key, value)
