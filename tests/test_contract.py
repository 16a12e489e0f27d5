"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from citewright.workloads import registered
from oracle.sql import statements
from tests.compare import connect, difference

FOLDER = contract.SMOKE_DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(statements()) == set(registered()) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(registered()))
def test_same_rows(spark, con, name):
    assert difference(spark, con, FOLDER, registered()[name], statements()[name]) is None


def test_entry(spark):
    answers = contract.entry(spark)
    assert answers.count() == spark.read.parquet(f"{FOLDER}/benchmark.parquet").count()
