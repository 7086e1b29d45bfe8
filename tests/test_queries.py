import pytest
from conftest import plain

from sparkloom import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_has_the_answer_of_its_sql(spark, tables, data, name):
    got, want = Q.QUERIES[name](spark, data).toPandas(), tables.sql(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(Q.QUERIES.keys() - Q.SQL.keys()))
def test_query_without_sql_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() > 0
