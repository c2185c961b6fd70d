"""Every query with SQL gives the same rows as that SQL."""

import pytest

from kerbside.plans import registry
from tests.oracle import differences, views

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert differences(registry.queries()[name](spark, SF), con, SQL[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).limit(1).count() == 1


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
