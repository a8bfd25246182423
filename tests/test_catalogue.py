"""Each query against its SQL, written from the literal definition."""

import pytest

from netmoment.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_all_have_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
