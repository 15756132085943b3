import pytest
from conftest import same_as_sql

from gridloom import plans as q
from gridloom.queries import register_slice


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_is_as_sql_says(spark, name):
    same_as_sql(spark, q.queries()[name], q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_runs(spark, name):
    assert q.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_registration_never_gets_worse(spark):
    assert all(r["after"] >= r["before"] - 1e-9 for r in register_slice(spark, "/root/testdata/sf0.001").collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
