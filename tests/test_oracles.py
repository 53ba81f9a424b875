"""Every registered query with SQL, on the smallest tables."""

import pytest
from oracle import assert_same

from tidewarden import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    assert_same(plans.QUERIES[name](spark, small), plans.ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert plans.QUERIES[name](spark, small).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
