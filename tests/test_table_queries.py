import pytest

from gatecrest.plans import project_queries, table_queries
from tests.oracle import from_spark, from_sql

SF = "/root/testdata/sf0.001"
QUERIES, SQL = table_queries.QUERIES | project_queries.QUERIES, table_queries.SQL | project_queries.SQL


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_what_its_sql_gives(spark, name):
    got = from_spark(QUERIES[name](spark, SF))
    assert got[1]
    if name in SQL:
        assert got == from_sql(SQL[name], SF)


def test_driver_contract(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(table_queries.QUERIES) <= set(names)
    assert entry.entry(spark).count() > 0
