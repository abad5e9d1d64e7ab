"""Importing the queries takes no session, on the driver and on the workers."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_queries_are_read_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql())); from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_functions_of_a_query_module_reach_the_workers(spark):
    from quernstone.plans.catalogue import QUERIES

    assert QUERIES["structure_encoder"](spark, DATA).count()
