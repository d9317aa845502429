import pytest
from verify import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry._core().SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_runs(spark):
    core = entry._core()
    for name in core.QUERIES.keys() - core.SQL.keys():
        assert core.QUERIES[name](spark, FOLDER).count() > 0
