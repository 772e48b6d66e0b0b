import pytest

import __spark_entry__ as entry
from veilwork.plans import catalog

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, con, name):
    compare(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], con)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["category", "n"] and got.count() > 0
