"""Every registered query against its SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import DataFrame

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("without", [("larkspur/llm", "tests/llm"), ("larkspur/llm", "tests/llm", "corpus_pipeline.py")])
def test_optional_parts_may_be_missing(folder, without):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    gone = [os.path.join(root, p) for p in without]
    skip = lambda at, names: [n for n in names if n in (".git", "__pycache__") or os.path.join(at, n) in gone]
    shutil.copytree(root, f"{folder}/copy", ignore=skip)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*sorted(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=f"{folder}/copy", capture_output=True, text=True, check=True,
                          env=os.environ | {"PYTHONPATH": f"{folder}/copy"})
    found = done.stdout.split()
    assert "search_species" in found and "pipeline" not in found and not any(n.startswith("op") for n in found)


def test_entry(spark):
    frame = entry(spark)
    assert isinstance(frame, DataFrame) and frame.count() == 10


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, data, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], data) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
