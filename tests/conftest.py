"""Shared session of the tests."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


def make_session(cpus: str = "8") -> SparkSession:
    from larkspur.session import ship

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("larkspur")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()


@pytest.fixture
def folder():
    """A new empty folder, left in place afterwards."""
    return tempfile.mkdtemp(prefix="larkspur-test-")


@pytest.fixture(scope="session")
def data():
    return DATA
