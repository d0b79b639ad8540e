"""Every query that has SQL against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

from notewright.plans import catalogue
from tests.compare import compare, connect

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same(spark, name):
    a, b = compare(spark, connect(DATA), name, catalogue.QUERIES[name], catalogue.SQL[name], DATA)
    assert a == b


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).columns
