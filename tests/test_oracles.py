"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check_oracles import connect, difference

NAMES = list(contract.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf_dir, name):
    ours = contract.queries()[name](spark, sf_dir).toPandas()
    assert len(ours)
    if name in contract.oracle_sql():
        assert difference(ours, duck.execute(contract.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
