"""Every query with SQL gives its SQL's rows; the others run and give rows."""

import pytest
from oracle import both, connect

from tidemark.queries.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, data, con, name):
    ours, theirs = both(QUERIES[name](spark, data), con, ORACLES[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
