import pytest
from check_queries import connect, differences

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert differences(got, con.sql(entry.oracle_sql()[name]).df()) == []


def test_entry(spark):
    assert entry.entry(spark).count() >= 1


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
