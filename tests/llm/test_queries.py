"""The operators' queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from citewright.llm import queries
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_all_operators_and_the_pipeline_are_registered():
    names = list(queries.registered())
    assert sorted(int(name[2:].split("_")[0]) for name in names if name != "pipeline") == list(range(1, 14))
    assert "pipeline" in names and set(queries.statements()) <= set(names)


@pytest.mark.parametrize("name", list(queries.statements()))
def test_same_rows(spark, name):
    assert difference(spark, connect(FOLDER), FOLDER, queries.registered()[name], queries.statements()[name]) is None
