"""Queries of the corpus problems that have SQL."""

from pathlib import Path

import pytest

from notewright.llm import queries
from tests.compare import compare, connect

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same(spark, name):
    a, b = compare(spark, connect(DATA), name, queries.QUERIES[name], queries.SQL[name], DATA)
    assert a == b
