"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as driver
import oracle
from check_oracle import connection, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


def test_every_query_has_sql():
    own = {name for name, query in driver.queries().items() if query.__module__ == driver.__name__}
    assert own == oracle.statements().keys()


@pytest.mark.parametrize("name", list(oracle.statements()))
def test_query(spark, con, name):
    found = driver.queries()[name](spark, SF_DIR).toPandas()
    assert difference(found, con.execute(driver.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
