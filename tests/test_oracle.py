"""Every registered query against its SQL counterpart, all values compared."""

import pytest

import __spark_entry__ as contract
from compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, connection):
    result = QUERIES[name](spark, SF_DIR)
    if name not in ORACLE:
        assert result.count() > 0
        return
    assert differences(result, connection, ORACLE[name]) == []


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    result = contract.entry(spark)
    assert result.count() == 150
    assert {"customer_id", "total_interactions", "recency_days"} <= set(result.columns)
