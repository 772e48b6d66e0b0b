import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from veilwork.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, name):
    compare(q.queries()[name](spark, SF), q.oracle_sql()[name], connect(SF))


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_a_row_per_document(spark, name):
    assert q.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
