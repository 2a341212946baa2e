"""Every query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from checks.compare import differences, oracle_connection

ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def connection(data):
    return oracle_connection(data)


@pytest.mark.parametrize("name", contract.queries())
def test_query(spark, data, connection, name):
    rows = contract.queries()[name](spark, data).toArrow()
    if name in ORACLES:
        problem = differences(rows, connection.sql(ORACLES[name]).to_arrow_table())
        assert problem is None, problem
    else:
        assert rows.num_rows > 0


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(ORACLES) <= set(contract.queries())
